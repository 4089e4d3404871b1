"""Fragments and tallies from streams of alignments.

Pairing keeps a read name's open end until its mate comes; an event-time watermark lets
go of ends whose mate never does.  Counts are ordinary streaming aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.demux import flag_class
from ..operators.fragments import fold_end

OPEN_ENDS = ["rname", "qname", "coordinate", "reverse", "barcode", "until"]
FRAGMENT = "chrom string, start int, end int, barcode string"


OPEN_FRAGMENT = "start int, end int, barcode string, complete boolean"


def folded_stream(ends: DataFrame, time: str = "ts", delay: str = "10 minutes", min_distance: int = 10, max_distance: int = 5000) -> DataFrame:
    """Fragments as `fragments.paired` gives them, also for names with three or more ends.

    A name's fragment stays open, changed by each further end, until the watermark has
    passed its last end; then it comes out if it is complete.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *open_[:3])] if open_ and open_[3] else [], columns=["chrom", "start", "end", "barcode"])
            return
        rows = pd.concat(batches).sort_values([time, "coordinate", "reverse"])
        for at, reverse, barcode in zip(rows["coordinate"], rows["reverse"], rows["barcode"], strict=True):
            open_ = fold_end(open_, int(at), bool(reverse), None if pd.isna(barcode) else barcode, min_distance, max_distance)
        if open_ is not None:
            state.update(tuple(open_))
            state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([], columns=["chrom", "start", "end", "barcode"])

    marked = ends.withWatermark(time, delay)
    return marked.groupBy("rname", "qname").applyInPandasWithState(fold, FRAGMENT, OPEN_FRAGMENT, "append", GroupStateTimeout.EventTimeTimeout)


def paired_stream(ends: DataFrame, time: str = "ts", delay: str = "10 minutes", min_distance: int = 10, max_distance: int = 5000, buckets: int = 4096) -> DataFrame:
    """Complete fragments out of a stream of ends (rname, qname, coordinate, reverse, barcode, ts).

    A second end of a name completes the first if one is forward and one reverse, the
    distance fits and a barcode is there; either way the name is free again, so a
    fragment comes out at once.  Ends of a batch go by ``ord``, if they have it.  Names
    with three or more ends need `folded_stream`.

    Names are dealt into ``buckets`` by a hash; a bucket is one group with its open ends as
    state, so Python is called a bucket, not a name, and pairs all its ends at once.
    """
    ordered = "ord" in ends.columns

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(dict(zip(OPEN_ENDS, state.get, strict=True))) if state.exists else pd.DataFrame({c: [] for c in OPEN_ENDS})
        if state.hasTimedOut:
            made, rows = None, rows[rows["until"] > state.getCurrentWatermarkMs()]
        else:
            new = pd.concat(batches, ignore_index=True)
            new = new.sort_values("ord", kind="stable", ignore_index=True) if ordered else new
            new["until"] = new[time].astype("datetime64[ms]").astype("int64")
            made, rows = paired_rows(pd.concat([rows[OPEN_ENDS], new[OPEN_ENDS]], ignore_index=True) if len(rows) else new[OPEN_ENDS], min_distance, max_distance)
        if len(rows):
            state.update(tuple(rows[c].tolist() for c in OPEN_ENDS))
            state.setTimeoutTimestamp(int(max(rows["until"].min(), state.getCurrentWatermarkMs())) + 1)
        elif state.exists:
            state.remove()
        yield made if made is not None else pd.DataFrame([], columns=["chrom", "start", "end", "barcode"])

    dealt = ends.select("rname", "qname", F.col("coordinate").cast("int"), "reverse", "barcode", time, *(["ord"] if ordered else []), F.pmod(F.xxhash64("rname", "qname"), F.lit(buckets)).alias("_bucket"))
    state = "rname array<string>, qname array<string>, coordinate array<int>, reverse array<boolean>, barcode array<string>, until array<bigint>"
    return dealt.withWatermark(time, delay).groupBy("_bucket").applyInPandasWithState(pair, FRAGMENT, state, "append", GroupStateTimeout.EventTimeTimeout)


def paired_rows(rows: pd.DataFrame, low: int, high: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(fragments, ends left open) of ends in order: each name's first and second end are a
    pair, its third and fourth, and so on."""
    names = rows.groupby(["rname", "qname"], sort=False, dropna=False)
    name, k = names.ngroup().to_numpy(), names.cumcount().to_numpy()
    order = np.lexsort((k, name))
    odd = k[order] % 2 == 1
    second = order[odd]
    first = order[np.flatnonzero(odd) - 1]
    left = np.ones(len(rows), bool)
    left[first], left[second] = False, False
    a, b = rows.take(first).reset_index(drop=True), rows.take(second).reset_index(drop=True)
    back = b["reverse"].to_numpy(bool)
    at, other = a["coordinate"].to_numpy(), b["coordinate"].to_numpy()
    start, stop = np.where(back, at, other), np.where(back, other, at)
    code = a["barcode"].where(a["barcode"].notna(), b["barcode"])
    fits = (a["reverse"].to_numpy(bool) != back) & code.notna().to_numpy() & (stop - start >= low) & (stop - start <= high)
    made = pd.DataFrame({"chrom": a["rname"], "start": start, "end": stop, "barcode": code})[fits]
    return made.astype({"start": "int32", "end": "int32"}), rows[left]


def flag_counts_stream(alignments: DataFrame, barcode: str = "cell_bc", flag: str = "flag") -> DataFrame:
    """(barcode, type, n), for update or complete mode."""
    return alignments.select(F.col(barcode).alias("barcode"), flag_class(flag).alias("type")).where("type is not null").groupBy("barcode", "type").agg(F.count("*").alias("n"))


def barcode_counts_stream(reads: DataFrame, length: int, name: str = "name") -> DataFrame:
    return reads.groupBy(F.substring(name, 1, length).alias("barcode")).agg(F.count("*").alias("n"))


def windowed_counts_stream(reads: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes", key: str = "cell_bc") -> DataFrame:
    """Reads per cell and time window; closed windows in append mode."""
    return reads.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
