"""Barcodes: histograms, exact and fuzzy matching against a list.

Fuzzy joins are equi-joins.  Two strings of one length with at most k differences
agree in at least one of k+1 pieces, so pieces meet and only pairs that share one
are compared.  Distinct barcodes are matched, reads then join their result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import hamming, reverse_complement, zero_padded
from .graph import components


def histogram(reads: DataFrame, length: int, name: str = "name", ordinal: str = "ordinal", max_reads: int = 1_000_000) -> DataFrame:
    """(barcode, n): the first ``length`` letters of the first reads' names (0: of all)."""
    if length < 4:
        raise ValueError("barcode length must be at least 4")
    if 0 < max_reads < 1000:
        raise ValueError("max_reads must be at least 1000, or 0 for all")
    some = reads.where(F.col(ordinal) < max_reads) if max_reads > 0 else reads
    return some.groupBy(F.substring(name, 1, length).alias("barcode")).agg(F.count("*").alias("n"))


def _pieces(barcode: Column, length: Column, k: int) -> Column:
    """(number, length, text) of the k+1 pieces."""
    n = k + 1
    cut = lambda i: F.floor(length * i / n).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("i"), length.alias("length"), F.substring(barcode, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(n)])


def within(left: DataFrame, right: DataFrame, most: int, left_on: str, right_on: str) -> DataFrame:
    """Pairs of distinct strings of equal length with at most ``most`` differences:
    (left_on, right_on, distance)."""
    side = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct().select(c, F.explode(_pieces(F.col(c), F.length(c), most)).alias("p")).select(c, "p.*")
    pairs = side(left, left_on).join(side(right, right_on), ["i", "length", "piece"]).select(left_on, right_on).distinct()
    return pairs.withColumn("distance", hamming(left_on, right_on)).where(F.col("distance") <= most)


def nearest_unique(reads: DataFrame, barcodes: DataFrame, most: int, seen: str = "seen", listed: str = "barcode") -> DataFrame:
    """(seen, barcode, distance): itself if listed, else the one nearest within ``most``
    if no other is as near; no row otherwise."""
    near = within(reads, barcodes, most, seen, listed)
    best = near.groupBy(seen).agg(F.min(F.struct("distance", listed)).alias("b"), F.collect_list("distance").alias("all"))
    lone = F.size(F.filter("all", lambda d: d == F.col("b.distance"))) == 1
    return best.where(lone).select(seen, F.col(f"b.{listed}").alias(listed), F.col("b.distance").alias("distance"))


def first_within(reads: DataFrame, barcodes: DataFrame, most: int = 1, seen: str = "seen", listed: str = "barcode") -> DataFrame:
    """(seen, barcode): the first listed barcode in order with at most ``most`` differences."""
    return within(reads, barcodes, most, seen, listed).groupBy(seen).agg(F.min(listed).alias(listed))


def merge_into_whitelist(counts: DataFrame, whitelist: DataFrame, most: int = 1) -> DataFrame:
    """(barcode, n): counts moved to the listed barcode itself, or to the nearest within
    ``most`` (the smallest of equals); those without one are dropped."""
    near = within(counts.withColumnRenamed("barcode", "seen"), whitelist, most, "seen", "barcode")
    to = near.groupBy("seen").agg(F.min(F.struct("distance", "barcode")).alias("b")).select("seen", F.col("b.barcode").alias("barcode"))
    moved = counts.withColumnRenamed("barcode", "seen").join(to, "seen")
    return moved.groupBy("barcode").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _merge_greedily(counts: pd.DataFrame, absolute: int) -> pd.DataFrame:
    """Sequential merge in a fixed order (count falling, barcode rising)."""
    order = sorted(zip(counts["barcode"], counts["n"], strict=True), key=lambda x: (-x[1], x[0]))
    total = dict(order)
    for one, _ in order:
        n = total[one]
        for i in range(len(one)):
            hit = next((o for c in "ACGTN" if c != one[i] and (o := one[:i] + c + one[i + 1 :]) in total and total[o] and (n == absolute or n < 0.5 * total[o])), None)
            if hit:
                total[hit] += n
                total[one] = 0
                break
    return pd.DataFrame([(b, n) for b, n in total.items() if n > 0], columns=["barcode", "n"])


def merge_neighbours(counts: DataFrame, min_count: int = 10, absolute: int = 1) -> DataFrame:
    """Barcodes one substitution from a more than twice as frequent one, or with
    ``absolute`` reads, are added to it, one after the other.

    The order matters only among barcodes that neighbours join, so each connected
    component of them is a group of its own; barcodes without neighbours stay as they are.
    """
    kept = counts.where(F.col("n") >= min_count).select("barcode", "n")
    pairs = within(kept, kept.select(F.col("barcode").alias("other")), 1, "barcode", "other").where("distance = 1 and barcode < other")
    label = components(pairs, "barcode", "other").withColumnRenamed("node", "barcode")
    alone = kept.join(label, "barcode", "left_anti").where("n > 0").select("barcode", F.col("n").cast("long").alias("n"))
    merged = kept.join(label, "barcode").groupBy("label").applyInPandas(lambda pdf: _merge_greedily(pdf, absolute), "barcode string, n long")
    return alone.unionByName(merged)


def ranked_cells(counts: DataFrame, cells: int = 10_000, prefix: str = "CELL_") -> DataFrame:
    """(cell_name, barcode_sequence, count) of the largest; ties by barcode, falling."""
    top = counts.orderBy(F.desc("n"), F.desc("barcode")).limit(cells)
    order = Window.orderBy(F.desc("n"), F.desc("barcode"))
    numbered = top.withColumn("k", F.row_number().over(order)).withColumn("digits", F.length(F.count("*").over(Window.partitionBy()).cast("string")) + 1)
    return numbered.select(F.concat(F.lit(prefix), zero_padded("k", F.col("digits"))).alias("cell_name"), F.col("barcode").alias("barcode_sequence"), F.col("n").alias("count"))


def detect(reads: DataFrame, length: int, whitelist: DataFrame | None = None, max_reads: int = 1_000_000, min_count: int = 10, cells: int = 10_000, most: int = 1, prefix: str = "CELL_") -> DataFrame:
    """Barcodes that look like cells: counted, pruned, merged and ranked."""
    counts = histogram(reads, length, max_reads=max_reads).where(F.col("n") >= min_count)
    merged = merge_into_whitelist(counts, whitelist, most) if whitelist is not None else merge_neighbours(counts, min_count, most)
    return ranked_cells(merged, cells, prefix)


def prefix_match(reads: DataFrame, barcodes: DataFrame, seen: str = "seen", listed: str = "barcode", quality: str | None = None) -> DataFrame:
    """Prefix-tree matches with at most one substitution.

    With d the longest prefix of a string that begins a listed barcode: if all of it,
    the match is exact (position -1).  Otherwise listed barcodes match that agree
    before and behind place d.  An ``N`` may stand for any letter at no cost; such
    strings are spelled out first.  Returns (seen[, quality], barcode, position); with
    a quality column only the best match: the exact one, else that of the highest
    quality at its position if above 0, ties in order A, C, G, T.
    """
    keep = [seen, *([quality] if quality else [])]
    listed_ = barcodes.select(F.col(listed).alias("_w")).where("_w is not null").distinct()
    spelled = reads.select(*keep).where(F.col(seen).isNotNull()).distinct().withColumn("_s", F.explode(F.array(seen)))
    plain = spelled.where(~F.col(seen).contains("N"))
    with_n = spelled.where(F.col(seen).contains("N"))
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    grown = F.aggregate(
        F.split(F.col(seen), ""),
        F.array(F.lit("")),
        lambda out, c: F.flatten(F.transform(out, lambda o: F.when(c == "N", F.transform(letters, lambda x: F.concat(o, x))).otherwise(F.array(F.concat(o, c))))),
    )
    all_ = plain.unionByName(with_n.withColumn("_s", F.explode(grown)))
    begun = listed_.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("_w")), lambda n: F.substring("_w", 1, n))).alias("_p")).distinct()
    cuts = all_.select(*keep, "_s", F.explode(F.transform(F.sequence(F.lit(0), F.length("_s")), lambda n: F.substring("_s", 1, n))).alias("_p"))
    depth = cuts.join(begun, "_p", "left_semi").groupBy(*keep, "_s").agg(F.max(F.length("_p")).alias("_d"))
    exact = depth.where(F.col("_d") == F.length("_s")).join(listed_, F.col("_s") == F.col("_w")).select(*keep, F.col("_w").alias(listed), F.lit(-1).alias("position"))
    rest = depth.where(F.col("_d") < F.length("_s"))
    left = rest.withColumns({"_a": F.expr("substring(_s, 1, _d)"), "_b": F.expr("substring(_s, _d + 2)"), "_l": F.length("_s")})
    lists = listed_.select("_w", F.explode(F.sequence(F.lit(0), F.length("_w") - 1)).alias("_d")).withColumns(
        {"_a": F.expr("substring(_w, 1, _d)"), "_b": F.expr("substring(_w, _d + 2)"), "_l": F.length("_w")}
    )
    # a spelled-out N is no substitution
    near = left.join(lists, ["_d", "_a", "_b", "_l"]).where(F.expr(f"substring(`{seen}`, _d + 1, 1) <> 'N'")).select(*keep, F.col("_w").alias(listed), F.col("_d").alias("position"))
    found = exact.unionByName(near).distinct()
    if not quality:
        return found
    at = F.ascii(F.expr(f"substring({quality}, position + 1, 1)")) - 33
    scored = found.withColumn("_q", F.when(F.col("position") < 0, F.lit(1 << 20)).otherwise(at)).where(F.col("_q") > 0)
    order = Window.partitionBy(*keep).orderBy(F.desc("_q"), listed)
    return scored.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_q", "_k")


def position_hits(reads: DataFrame, barcodes: DataFrame, positions: int, length: int, sequence: str = "seq", listed: str = "barcode") -> DataFrame:
    """(position, hits): reads that have a listed barcode at each of the first places, from 0."""
    words = barcodes.select(F.col(listed).alias("_w")).distinct()
    window = lambda k: F.struct(k.alias("position"), F.substring(F.col(sequence), k + 1, F.lit(length)).alias("_w"))
    cut = reads.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), window)).alias("x")).select("x.*")
    return cut.join(words, "_w", "left_semi").groupBy("position").agg(F.count("*").alias("hits"))


def start_position(reads: DataFrame, barcodes: DataFrame, start: int, length: int, sequence: str = "seq", ordinal: str = "ordinal", max_reads: int = 10_000, threshold: float = 0.8, listed: str = "barcode") -> dict:
    """Whether enough of the first reads have a listed barcode at ``start``; if not, where most do.

    A summary of a bounded number of reads, so an action: {ok, fraction, best, best_fraction}.
    """
    probe = reads.where(F.col(ordinal) < max_reads).select(ordinal, sequence)
    total = probe.count()
    hits = {r["position"]: r["hits"] for r in position_hits(probe, barcodes, start + 10, length, sequence, listed).collect()}
    share = hits.get(start, 0) / total if total else 0.0
    out = {"ok": share >= threshold, "fraction": share, "best": start, "best_fraction": share}
    if not out["ok"] and hits:
        best = min(hits, key=lambda k: (-hits[k], k))
        out |= {"best": best, "best_fraction": hits[best] / total}
    return out


def needs_reverse_complement(reads: DataFrame, barcodes: DataFrame, start: int, length: int, sequence: str = "seq", ordinal: str = "ordinal", probe: int = 10_000, misses: int = 4_000, listed: str = "barcode") -> DataFrame:
    """One row (missed, reverse): of the first reads, those without a listed barcode."""
    some = reads.where(F.col(ordinal) < probe).select(F.substring(sequence, start + 1, length).alias("_w"))
    missed = some.join(barcodes.select(F.col(listed).alias("_w")).distinct(), "_w", "left_anti").agg(F.count("*").alias("missed"))
    return missed.withColumn("reverse", F.col("missed") >= misses)


def oriented(barcodes: DataFrame, reverse: bool, listed: str = "barcode") -> DataFrame:
    return barcodes.withColumn(listed, reverse_complement(listed)) if reverse else barcodes
