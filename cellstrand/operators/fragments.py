"""Fragments out of read pairs: eligibility, pairing, collapsing, duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import fragment_key, reference_length


def eligible_ends(alignments: DataFrame, min_mapq: int = 30, chromosomes: str = "^chr", barcode: str = "cell_bc", name_pattern: str | None = None, cells: DataFrame | None = None, first: int = 0) -> DataFrame:
    """(ord, rname, qname, coordinate, reverse, barcode) of the alignments that may end a fragment.

    Forward reads give a start four bases in, reverse ones an end five bases in; contigs
    begin at place ``first``.
    The barcode is a tag, or what a pattern finds in the read name.  A list of cells
    drops other barcodes, not reads without one.
    """
    code = F.nullif(F.regexp_extract("qname", name_pattern, 0), F.lit("")) if name_pattern else F.col(barcode)
    reverse = F.col("flag").bitwiseAND(16) != 0
    stop = F.col("pos") + F.when(F.col("cigar").isNull() | (F.col("cigar") == "*"), 1).otherwise(reference_length("cigar"))
    rows = alignments.where((F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(4) == 0) & (F.col("pos") >= first) & F.col("rname").rlike(f"(?i){chromosomes}"))
    ends = rows.select(
        F.col("ordinal").alias("ord") if "ordinal" in alignments.columns else F.col("pos").cast("long").alias("ord"),
        "rname",
        "qname",
        F.when(reverse, stop - 5).otherwise(F.col("pos") + 4).cast("int").alias("coordinate"),
        reverse.alias("reverse"),
        code.alias("barcode"),
    )
    if cells is None:
        return ends
    known = cells.select(F.col("barcode").alias("_cell")).distinct()
    return ends.join(known, F.col("barcode") == F.col("_cell"), "left").where("barcode is null or _cell is not null").drop("_cell")


def fold_end(state: list | None, at: int, reverse: bool, barcode: str | None, low: int, high: int) -> list | None:
    """The open fragment [start, end, barcode, complete] of a read name after one more end.

    An end that does not fit closes what is open without result.
    """
    if state is None:
        return [None if reverse else at, at if reverse else None, barcode, False]
    other = state[0] if reverse else state[1]
    size = None if other is None else (at - other if reverse else other - at)
    if size is None or not low <= size <= high or (barcode is None and state[2] is None):
        return None
    out = [state[0], state[1], state[2] if state[2] is not None else barcode, True]
    out[1 if reverse else 0] = at
    return out


def fold_pairs(rows: list[tuple[int, bool, str | None]], low: int, high: int) -> tuple[int, int, str] | None:
    """Ends of one read name in order; the complete fragment that is left, if any."""
    state: list | None = None
    for at, reverse, barcode in rows:
        state = fold_end(state, at, reverse, barcode, low, high)
    return (state[0], state[1], state[2]) if state and state[3] else None


def paired(ends: DataFrame, min_distance: int = 10, max_distance: int = 5000) -> DataFrame:
    """(chrom, start, end, barcode), a row per complete fragment.

    Names with two ends are one aggregate: a forward and a reverse end within the
    distances, and a barcode (the first in order that is there).  Names with more
    are folded one end after the other.
    """
    grouped = ends.groupBy("rname", "qname").agg(
        F.count("*").alias("n"),
        F.max(F.when(~F.col("reverse"), F.col("coordinate"))).alias("start"),
        F.max(F.when(F.col("reverse"), F.col("coordinate"))).alias("end"),
        F.min_by("barcode", F.when(F.col("barcode").isNotNull(), F.struct("ord", "reverse"))).alias("barcode"),
    )
    size = F.col("end") - F.col("start")
    two = grouped.where((F.col("n") == 2) & F.col("barcode").isNotNull() & size.between(min_distance, max_distance))
    two = two.select(F.col("rname").alias("chrom"), "start", "end", "barcode")
    many = ends.join(grouped.where("n > 2").select("rname", "qname"), ["rname", "qname"], "left_semi")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "coordinate", "reverse"])
        rows = [(int(c), bool(r), b) for c, r, b in zip(pdf["coordinate"], pdf["reverse"], pdf["barcode"], strict=True)]
        found = fold_pairs(rows, min_distance, max_distance)
        return pd.DataFrame([(key[0], *found)] if found else [], columns=["chrom", "start", "end", "barcode"])

    return two.unionByName(many.groupBy("rname", "qname").applyInPandas(fold, "chrom string, start int, end int, barcode string"))


def _collapse(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group the row with the largest count takes the sum; of equals the first by key text."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc("count"), fragment_key("chrom", "start", "end", "barcode"))
    return df.withColumns({"_k": F.row_number().over(order), "_sum": F.sum("count").over(w)}).where("_k = 1").withColumn("count", F.col("_sum")).drop("_k", "_sum")


def collapsed(pairs: DataFrame) -> DataFrame:
    """(chrom, start, end, barcode, count): equal fragments counted, then those of a
    barcode that share a start, then an end, merged, then the barcodes of one place."""
    counted = pairs.groupBy("chrom", "start", "end", "barcode").agg(F.count("*").alias("count"))
    by_start = _collapse(counted, ["chrom", "start", "barcode"])
    by_end = _collapse(by_start, ["chrom", "end", "barcode"])
    return _collapse(by_end, ["chrom", "start", "end"])


def fragment_ids(pairs: DataFrame) -> DataFrame:
    """(key, id): distinct fragments as text, numbered from 0 in order of their keys.

    Keys that share their first letters (contig and leading digits) are one part, numbered
    from the size of the parts before, so no task holds all keys.
    """
    keys = pairs.select(fragment_key("chrom", "start", "end", "barcode").alias("key")).distinct()
    placed = keys.withColumn("part", F.substring("key", 1, 8))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return placed.withColumn("k", own).join(sizes, "part").select("key", (F.col("first") + F.col("k") - 1).alias("id"))


def create_fragments(alignments: DataFrame, min_mapq: int = 30, chromosomes: str = "^chr", barcode: str = "cell_bc", name_pattern: str | None = None, cells: DataFrame | None = None, max_distance: int = 5000, min_distance: int = 10, first: int = 0) -> DataFrame:
    return collapsed(paired(eligible_ends(alignments, min_mapq, chromosomes, barcode, name_pattern, cells, first), min_distance, max_distance))


def quality_sum(qual: str = "qual", least: int = 15, offset: int = 33) -> Column:
    """Sum of the base qualities of at least ``least``, by which duplicates are chosen."""
    values = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)
    return F.aggregate(values, F.lit(0), lambda n, q: n + F.when(q >= least, q).otherwise(0))


def best_molecules(alignments: DataFrame, place: list[str], by_barcode: bool = False, barcode: str = "cell_bc") -> DataFrame:
    """Alignments without duplicates: of each place the template with the highest
    `quality_sum` over its mates stays, of equals the first by name; tables without
    qualities go by mapping quality."""
    if "qual" not in alignments.columns:
        return remove_duplicates(alignments, place, [F.desc("mapq"), "qname"], by_barcode, barcode)
    scored = alignments.withColumn("_score", F.sum(quality_sum()).over(Window.partitionBy("qname")))
    return remove_duplicates(scored, place, [F.desc("_score"), "qname"], by_barcode, barcode).drop("_score")


def mark_duplicates(reads: DataFrame, place: list[str], order: list, by_barcode: bool = False, barcode: str = "cell_bc") -> DataFrame:
    """``duplicate``: true but for the best read of each place.

    ``place`` names what tells molecules apart (contig, 5' ends, strand); ``order``
    says which read is best and must be total.
    """
    w = Window.partitionBy(*place, *([barcode] if by_barcode else [])).orderBy(*order)
    return reads.withColumn("duplicate", F.row_number().over(w) > 1)


def remove_duplicates(reads: DataFrame, place: list[str], order: list, by_barcode: bool = False, barcode: str = "cell_bc") -> DataFrame:
    return mark_duplicates(reads, place, order, by_barcode, barcode).where("not duplicate").drop("duplicate")
