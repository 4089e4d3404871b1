"""Counting fragments on features, quality control per cell and per feature, cell calling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from .intervals import Span, overlap_flags, overlap_join, tss_bins


def feature_label(chrom: str = "chrom", start: str = "start", end: str = "end") -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def distinct_features(features: DataFrame) -> DataFrame:
    """(chrom, start, end, feature), once each."""
    return features.select("chrom", "start", "end").distinct().withColumn("feature", feature_label())


def exclude_regions(features: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features without overlap, one row with the number of overlapping pairs)."""
    pairs = overlap_join(features, blacklist).agg(F.count("*").alias("n_excluded"))
    return overlap_join(features, blacklist, how="anti"), pairs


def feature_counts(fragments: DataFrame, features: DataFrame, bin_width: int = 2048) -> DataFrame:
    """(feature, barcode, n): overlapping fragment rows; a fragment's own count plays no part."""
    hits = overlap_join(fragments.select("chrom", "start", "end", "barcode"), distinct_features(features), bin_width=bin_width)
    return hits.groupBy(F.col("r_feature").alias("feature"), "barcode").agg(F.count("*").alias("n"))


def average_fragments_per_barcode(counts: DataFrame) -> DataFrame:
    return counts.agg((F.sum("n") / F.nullif(F.countDistinct("barcode"), F.lit(0))).alias("average"))


def binary(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n") > 0).withColumn("n", F.lit(1).cast("long"))


def cell_qc_metrics(
    fragments: DataFrame, key: str | None, peaks: DataFrame, promoters: DataFrame, tss: DataFrame, enhancers: DataFrame, mito: str = "chrM", min_frags: int = 5, tss_gap: int = 1001
) -> DataFrame:
    """Per barcode: total_frags and the parts of them on each kind of region.

    Each row is a fragment, so ``key``, a column that tells them apart, is not looked at.
    A fragment counts once a kind, however many regions it meets; start sites count up
    to 1000 bases away.
    """
    own = fragments.select("chrom", "start", "end", "barcode")
    kinds = {f"in_{n}": (df, gap) for n, df, gap in (("peak", peaks, 0), ("promoter", promoters, 0), ("tss", tss, tss_gap), ("enhancer", enhancers, 0))}
    flagged = overlap_flags(own, kinds)
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    made = flagged.groupBy(F.col("barcode").alias("bc")).agg(
        n.alias("total_frags"),
        *[share(F.col(f"in_{k}")).alias(f"frac_{k}") for k in ("peak", "promoter", "tss", "enhancer")],
        share(F.col("chrom") == mito).alias("frac_mito"),
    )
    return made.where(F.col("total_frags") > min_frags)


@dataclass(frozen=True)
class CellFilter:
    """Thresholds on `cell_qc_metrics`."""

    min_uniq_frags: int = 3000
    max_uniq_frags: int = 50000
    min_frac_peak: float = 0.3
    min_frac_tss: float = 0.0
    min_frac_enhancer: float = 0.0
    min_frac_promoter: float = 0.1
    max_frac_mito: float = 0.15

    def condition(self) -> Column:
        return (
            (F.col("total_frags") >= self.min_uniq_frags)
            & (F.col("total_frags") <= self.max_uniq_frags)
            & (F.col("frac_peak") >= self.min_frac_peak)
            & (F.col("frac_tss") >= self.min_frac_tss)
            & (F.col("frac_enhancer") >= self.min_frac_enhancer)
            & (F.col("frac_promoter") >= self.min_frac_promoter)
            & (F.col("frac_mito") <= self.max_frac_mito)
        )


def called_cells(qc: DataFrame, thresholds: CellFilter = CellFilter()) -> DataFrame:
    return qc.where(thresholds.condition())


def flag_called(qc: DataFrame, called: DataFrame) -> DataFrame:
    mark = called.select("bc").distinct().withColumn("cell_called", F.lit(True))
    return qc.join(mark, "bc", "left").withColumn("cell_called", F.coalesce("cell_called", F.lit(False)))


def filter_counts(counts: DataFrame, cell_above: int = 200, feature_above: int = 10, least: int = 10) -> DataFrame:
    """Cells with more counts than ``cell_above``, then features above ``feature_above``.

    Either filter only applies if ``least`` cells or features get through; two small
    counts are looked at for that, on a matrix that is written once.
    """
    counts = written(counts, "counts")
    for column, above in (("barcode", cell_above), ("feature", feature_above)):
        kept = counts.groupBy(column).agg(F.sum("n").alias("_n")).where(F.col("_n") > above).select(column)
        if kept.limit(least).count() >= least:
            counts = counts.join(kept, column, "left_semi")
    return counts


def stats_per_cell(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("barcode").alias("cell")).agg(F.sum("n").alias("counts_per_cell"), F.count("*").alias("features_per_cell"))


def stats_per_feature(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.sum("n").alias("counts_per_feature"), F.count("*").alias("cells_per_feature"))


def feature_flags(features: DataFrame, promoters: DataFrame, enhancers: DataFrame, tss: DataFrame, genes: DataFrame) -> DataFrame:
    """Per feature, what it overlaps; ``intergenic`` if no gene."""
    kinds = {"promoter_overlaps": promoters, "enhancer_overlaps": enhancers, "tss_overlaps": tss, "gene_overlaps": genes}
    return overlap_flags(features.distinct(), kinds).withColumn("intergenic", ~F.col("gene_overlaps"))


def tss_profile(fragments: DataFrame, tss: DataFrame, key: str) -> DataFrame:
    """(dists, agg_tss_scores): hits per bin around start sites over the mean of the
    two outermost bins, averaged over the sites whose outermost bins have hits."""
    bins = tss_bins(tss, [key, "chrom"])
    hits = overlap_join(bins, fragments.select("chrom", "start", "end")).groupBy(key, "bin").agg(F.count("*").alias("n"))
    outer = hits.groupBy(key).agg((F.sum(F.when(F.col("bin").isin(0, 38), F.col("n"))) / 2).alias("flank")).where(F.col("flank") > 0)
    sites = outer.agg(F.count("*").alias("sites"))
    summed = hits.join(outer, key).groupBy("bin").agg(F.sum(F.col("n") / F.col("flank")).alias("score"))
    grid = fragments.sparkSession.range(39).select(F.col("id").cast("int").alias("bin"))
    scores = grid.join(summed, "bin", "left").crossJoin(F.broadcast(sites)).where(F.col("sites") > 0)
    return scores.select((F.col("bin") * 100 - 1900).alias("dists"), (F.coalesce("score", F.lit(0.0)) / F.col("sites")).alias("agg_tss_scores"))


def tss_enrichment(profile: DataFrame) -> DataFrame:
    return profile.agg(F.max("agg_tss_scores").alias("tsse"))


def weighted_fractions(qc: DataFrame, names: tuple[str, ...] = ("frac_peak", "frac_promoter", "frac_tss", "frac_enhancer", "frac_mito")) -> DataFrame:
    """Shares over all fragments: of each cell's share, weighted by its fragments."""
    whole = F.sum("total_frags")
    return qc.agg(*[(F.sum(F.col("total_frags") * F.col(n)) / whole).alias(n) for n in names])


def insert_sizes(fragments: DataFrame, below: int = 800, width: int = 10) -> DataFrame:
    """Histogram of fragment lengths under ``below``, over all fragments."""
    size = F.col("end") - F.col("start")
    return fragments.where(size < below).groupBy((F.floor(size / F.lit(float(width))) * width).cast("long").alias("size")).agg(F.count("*").alias("n"))


def start_site_enrichment(sites: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """Per site (its own and a left flank interval): (hits over + 1) / (hits left + 1);
    intervals that only touch count as hits."""
    over = overlap_join(sites, reads, gap=1).groupBy(key).agg(F.count("*").alias("n_over"))
    left = overlap_join(sites, reads, Span("chrom", "left_start", "left_end"), gap=1).groupBy(key).agg(F.count("*").alias("n_left"))
    both = sites.select(key).join(over, key, "left").join(left, key, "left")
    zero = F.lit(0)
    return both.select(key, ((F.coalesce("n_over", zero) + 1) / (F.coalesce("n_left", zero) + 1)).alias("enrichment"))


def size_ranks(totals: DataFrame, total: str = "total") -> DataFrame:
    """Barcode ranks: the mean rank of each total, largest first, over distinct totals."""
    by_total = totals.groupBy(total).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc(total)).rowsBetween(Window.unboundedPreceding, -1)
    return by_total.withColumn("rank", F.coalesce(F.sum("n").over(order), F.lit(0)) + (F.col("n") + 1) / 2)


def knee_points(ranks: DataFrame, lower: int = 100, total: str = "total") -> DataFrame:
    """(knee, inflection) totals of the rank curve in log-log scale above ``lower``.

    The inflection is where the curve falls steepest, the knee the point before it
    that lies furthest above the chord from the first point to the inflection.
    """
    one = Window.partitionBy()
    order = Window.orderBy("x")
    pts = ranks.where(F.col(total) > lower).select(F.col(total).alias("t"), F.log10("rank").alias("x"), F.log10(total).alias("y"))
    slope = (F.lead("y").over(order) - F.col("y")) / F.nullif(F.lead("x").over(order) - F.col("x"), F.lit(0.0))
    ends = pts.withColumn("slope", slope).withColumns(
        {"xi": F.min_by("x", "slope").over(one), "yi": F.min_by("y", "slope").over(one), "ti": F.min_by("t", "slope").over(one), "x0": F.min("x").over(one), "y0": F.max("y").over(one)}
    )
    above = (F.col("y") - F.col("y0")) * (F.col("xi") - F.col("x0")) - (F.col("x") - F.col("x0")) * (F.col("yi") - F.col("y0"))
    return ends.where("x <= xi").agg(F.max_by("t", above).alias("knee"), F.first("ti").alias("inflection"))
