"""Interval joins without nested loops, and interval arithmetic.

Both sides are cut into bins; equal bins meet in an equi-join, which the optimizer
broadcasts or shuffles as sizes tell and AQE splits where a bin is crowded.  A pair
is kept in one bin only, the one where the later of the two starts, so nothing is
deduplicated.  Intervals are closed; starts may be negative.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    """Names of the columns of an interval."""

    chrom: str = "chrom"
    start: str = "start"
    end: str = "end"


def _bin(c: Column | str, width: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(width))).cast("long")


def binned(right: DataFrame, width: int) -> DataFrame:
    """(_chrom, _bin, _near): the intervals of each bin as one array, to be looked up by rows
    that are dealt out by bin; the bins' rows are few, so they are hashed."""
    rows = right.where("start <= end").withColumn("_bin", F.explode(F.sequence(_bin("start", width), _bin("end", width))))
    held = F.collect_list(F.struct(*[c for c in right.columns if c != "chrom"]))
    return rows.groupBy(F.col("chrom").alias("_chrom"), "_bin").agg(held.alias("_near")).hint("shuffle_hash")


def bins_of(parts: str, width: int) -> Column:
    """The bins that an array of (start, end) lies on."""
    return F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda s: s["start"] <= s["end"]), lambda s: F.sequence(_bin(s["start"], width), _bin(s["end"], width)))))


def overlap_join(
    left: DataFrame, right: DataFrame, left_span: Span = Span(), right_span: Span = Span(), *, how: str = "inner", gap: int = 0, bin_width: int = 2048, prefix: str = "r_"
) -> DataFrame:
    """Rows of both sides that overlap, or lie at most ``gap`` bases apart.

    ``gap=0`` asks for a common base, ``gap=1`` lets adjacent intervals count, and
    so on: a pair matches if the start of each is at most the other's end plus gap.
    Columns of the right side get ``prefix``.  ``how`` is inner, semi (rows of the
    left side with a match, once) or anti (those without).
    """
    if how not in ("inner", "semi", "anti"):
        raise ValueError(f"how must be inner, semi or anti, not {how}")
    r = right.select([F.col(f"`{c}`").alias(prefix + c) for c in right.columns])
    rs, re_ = prefix + right_span.start, prefix + right_span.end
    low, high = F.col(rs) - gap, F.col(re_) + gap
    r = r.withColumns({"_low": low, "_high": high}).where(F.col("_low") <= F.col("_high"))
    r = r.withColumn("_bin", F.explode(F.sequence(_bin("_low", bin_width), _bin("_high", bin_width))))
    l_ = left.where(F.col(left_span.start) <= F.col(left_span.end))
    l_ = l_.withColumn("_at", F.explode(F.sequence(_bin(left_span.start, bin_width), _bin(left_span.end, bin_width))))
    on = (
        (F.col(left_span.chrom) == F.col(prefix + right_span.chrom))
        & (F.col("_at") == F.col("_bin"))
        & (F.col(left_span.start) <= F.col("_high"))
        & (F.col("_low") <= F.col(left_span.end))
    )
    if how == "inner":
        once = F.col("_bin") == F.greatest(_bin("_low", bin_width), _bin(left_span.start, bin_width))
        return l_.join(r, on & once, "inner").drop("_at", "_bin", "_low", "_high")
    # rows of one interval match alike, so distinct intervals are looked up and rows joined to them
    places = l_.select(*[F.col(c).alias(n) for c, n in zip(_columns(left_span), ("_c", "_s", "_e"), strict=True)], "_at").distinct()
    on = (F.col("_c") == F.col(prefix + right_span.chrom)) & (F.col("_at") == F.col("_bin")) & (F.col("_s") <= F.col("_high")) & (F.col("_low") <= F.col("_e"))
    found = places.join(r, on, "left_semi").select("_c", "_s", "_e").distinct()
    same = reduce(lambda x, y: x & y, (left[c] == found[n] for c, n in zip(_columns(left_span), ("_c", "_s", "_e"), strict=True)))
    return left.join(found, same, "left_semi" if how == "semi" else "left_anti")


def _columns(span: Span) -> tuple[str, str, str]:
    return span.chrom, span.start, span.end


def overlap_flags(left: DataFrame, regions: dict[str, DataFrame | tuple[DataFrame, int]], bin_width: int = 2048) -> DataFrame:
    """``left`` (chrom, start, end and others that can be grouped by) with a flag for each kind
    of region: whether a row meets one.

    All kinds are one table, held as one array a bin, and the flags are bits that a row gathers
    there; only rows that lie on several bins are put together again.  A kind may come with a gap.
    """
    kinds = []
    for bit, (_, one) in enumerate(regions.items()):
        df, gap = one if isinstance(one, tuple) else (one, 0)
        kinds.append(df.select("chrom", (F.col("start") - gap).alias("start"), (F.col("end") + gap).alias("end"), F.lit(1 << bit).alias("bit")))
    near = binned(reduce(DataFrame.unionByName, kinds), bin_width)
    first, last = _bin("start", bin_width), _bin("end", bin_width)
    several = F.coalesce(first < last, F.lit(False))
    meets = lambda x: (F.col("start") <= x["end"]) & (x["start"] <= F.col("end")) & (F.col("start") <= F.col("end"))
    bits = F.coalesce(F.aggregate("_near", F.lit(0), lambda b, x: F.when(meets(x), b.bitwiseOR(x["bit"])).otherwise(b)), F.lit(0))
    look = lambda df: df.join(near, (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_bin")), "left").withColumn("_bits", bits)
    one = look(left.where(~several).withColumn("_at", first)).select(*left.columns, "_bits")
    rows = left.where(several).groupBy(*left.columns).agg(F.count("*").alias("_n"))
    many = look(rows.withColumn("_at", F.explode(F.sequence(first, last)))).groupBy(*left.columns, "_n").agg(F.bit_or("_bits").alias("_bits"))
    many = many.select(*left.columns, "_bits", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("col")
    return one.unionByName(many).select(*left.columns, *[(F.col("_bits").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(regions)])


def tsv_gap(bases: int) -> int:
    """The ``gap`` for "at most so many bases between"."""
    return bases + 1


def flatten(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping intervals of a group merged; adjacent ones stay apart."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def extent(df: DataFrame, by: list[str], start: str = "start", end: str = "end", strand: str | None = None) -> DataFrame:
    """Smallest start and largest end of each group; the strand of the first interval that has one."""
    made = [F.min(start).alias(start), F.max(end).alias(end)]
    if strand:
        made.append(F.coalesce(F.min_by(strand, F.when(F.col(strand) != 0, F.struct(start, end))), F.lit(0)).alias(strand))
    return df.groupBy(*by).agg(*made)


def tiles(lengths: DataFrame, width: int, chrom: str = "chrom", length: str = "length") -> DataFrame:
    """Bins of ``width`` bases, 1-based and closed, that cover each chromosome; the last is cut to fit."""
    n = F.ceil(F.col(length) / F.lit(float(width))).cast("long")
    some = lengths.where(F.col(length) > 0)
    out = some.select(chrom, length, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_k"))
    return out.select(chrom, (F.col("_k") * width + 1).alias("start"), F.least((F.col("_k") + 1) * width, F.col(length)).cast("long").alias("end"))


def tss_bins(tss: DataFrame, keep: list[str], at: str = "start", reach: int = 1900, width: int = 100) -> DataFrame:
    """Bins around each start site: middles at -reach to reach, ``width`` apart; ``bin`` from 0."""
    n = 2 * reach // width
    bins = tss.select(*keep, at, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("bin"))
    low = F.col(at) - reach - width // 2 + F.col("bin") * width
    return bins.select(*keep, "bin", (F.col("bin") * width - reach).alias("dists"), low.alias("start"), (low + width - 1).alias("end"))
