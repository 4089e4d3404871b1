"""Molecules per gene and cell: filters, UMI correction and their statistics.

Correction is sequential within one gene of one cell, so it runs in Python over
counted (UMI, position) pairs, streamed gene by gene through sorted partitions: a
task holds one gene of one cell at a time.  The pairs are counted before with
map-side combining, so a group has a row per distinct pair.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pairs = dict[tuple[str, int], int]

DUPLICATION_SLOTS = 1001


def pair_counts(reads: DataFrame) -> DataFrame:
    """(cell_id, gene_id, UMI, position, n)."""
    return reads.groupBy("cell_id", "gene_id", "UMI", "position").agg(F.count("*").alias("n"))


def low_gene_filter(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of genes with more than one read in a cell, (cell_id, filtered_gene))."""
    total = F.sum("n").over(Window.partitionBy("cell_id", "gene_id"))
    marked = pairs.withColumn("_total", total)
    dropped = marked.where("_total = 1").groupBy("cell_id").agg(F.countDistinct("gene_id").alias("filtered_gene"))
    return marked.where("_total > 1").drop("_total"), dropped


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or any number above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def _differences(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=False)) if len(a) == len(b) else max(len(a), len(b))


def _cuts(umi: str, most: int) -> set[str]:
    """A UMI and what is left of it without up to ``most`` letters."""
    out = {umi}
    for _ in range(most):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def _candidates(order: list[tuple[str, int]], most: int) -> Callable[[str], list[tuple[str, int]]]:
    """For a UMI the pairs, in order, that may be within ``most`` edits of it.

    UMIs that close share what is left of them without so many letters, so pairs are
    found by these keys and not by looking at all; in small groups all are.
    """
    if len(order) <= 64:
        return lambda umi: order
    by_key: dict[str, set[str]] = {}
    places: dict[str, list[tuple[str, int]]] = {}
    for pair in order:
        places.setdefault(pair[0], []).append(pair)
    for u in places:
        for key in _cuts(u, most):
            by_key.setdefault(key, set()).add(u)

    @functools.cache
    def near(umi: str) -> list[tuple[str, int]]:
        found = {u for key in _cuts(umi, most) for u in by_key.get(key, ())}
        return [pair for u in sorted(found) for pair in places[u]]

    return near


def _absorb(pairs: Pairs, takes: Callable[[str, int, int, str, int, int], bool], *, most: int, self_too: bool = False) -> tuple[Pairs, int]:
    """Goes through the pairs in order; each is absorbed by the first other that takes it.

    Pairs only take UMIs within ``most`` edits.
    """
    left, order, corrected = dict(pairs), sorted(pairs), 0
    near = _candidates(order, most)
    for one in order:
        for two in near(one[0]):
            if two not in left or (one == two and not self_too):
                continue
            if takes(*one, left[one], *two, left[two]):
                if one != two:
                    left[two] += left[one]
                del left[one]
                corrected += 1
                break
    return left, corrected


def correct_mode_1(pairs: Pairs) -> tuple[Pairs, int]:
    """UMIs one substitution apart, or equal at another position, if rarer or single."""
    return _absorb(pairs, lambda u, p, n, v, q, m: (n == 1 or n < m) and ((u == v and p != q) or _differences(u, v) == 1), most=1)


def correct_mode_2(pairs: Pairs, compat: bool = False) -> tuple[Pairs, int]:
    """UMIs at most one substitution apart within one position, if at most half as
    frequent or single.  ``compat`` lets a pair absorb itself, so single ones vanish."""
    return _absorb(pairs, lambda u, p, n, v, q, m: abs(p - q) < 2 and (n == 1 or 2 * n < m) and _differences(u, v) <= 1, most=1, self_too=compat)


def correct_mode_3(pairs: Pairs) -> tuple[Pairs, int]:
    """UMIs at most two edits apart, or equal at another position, if not more frequent."""
    return _absorb(pairs, lambda u, p, n, v, q, m: (n == 1 or n <= m) and ((u == v and p != q) or (u != v and _distance(u, v, 2) <= 2)), most=2)


CORRECTIONS: dict[int, Callable[[Pairs], tuple[Pairs, int]]] = {0: lambda p: (p, 0), 1: correct_mode_1, 2: correct_mode_2, 3: correct_mode_3}


def corrected_pairs(pairs: DataFrame, mode: int = 1, compat: bool = False) -> DataFrame:
    """(cell_id, gene_id, UMI, position, n, corrected): surviving pairs; ``corrected`` is
    the group's number of absorbed ones, on its first row; a group without survivors
    has one row with a null UMI."""
    if mode not in CORRECTIONS:
        raise ValueError(f"unknown UMI correction {mode}")
    if mode == 0:
        return pairs.withColumn("corrected", F.lit(0).cast("long"))
    fix = (lambda p: correct_mode_2(p, True)) if mode == 2 and compat else CORRECTIONS[mode]

    kinds = dict(pairs.dtypes)
    schema = f"cell_id {kinds['cell_id']}, gene_id {kinds['gene_id']}, UMI string, position int, n long, corrected long"
    names = ["cell_id", "gene_id", "UMI", "position", "n", "corrected"]

    def one(key: tuple, group: Pairs) -> list[tuple]:
        left, corrected = fix(group)
        rows = [(*key, u, p, n, 0) for (u, p), n in sorted(left.items())] or [(*key, None, None, None, 0)]
        rows[0] = (*rows[0][:5], corrected)
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come one after the other, sorted; a group may span batches."""
        key, group, out = None, {}, []
        for pdf in batches:
            for c, g, u, p, n in zip(pdf["cell_id"], pdf["gene_id"], pdf["UMI"], pdf["position"], pdf["n"], strict=True):
                if (c, g) != key:
                    if key is not None:
                        out += one(key, group)
                    key, group = (c, g), {}
                group[u, int(p)] = int(n)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"position": "Int32", "n": "Int64"})
                out = []
        if key is not None:
            yield pd.DataFrame(one(key, group), columns=names).astype({"position": "Int32", "n": "Int64"})

    dealt = pairs.select("cell_id", "gene_id", "UMI", "position", "n").repartition("cell_id", "gene_id").sortWithinPartitions("cell_id", "gene_id")
    return dealt.mapInPandas(run, schema)


def gene_counts(kept: DataFrame) -> DataFrame:
    """(gene_id, cell_id, n): surviving (UMI, position) pairs."""
    return kept.groupBy("gene_id", "cell_id").agg(F.count("UMI").alias("n"))


def duplication_histogram(kept: DataFrame) -> DataFrame:
    """(duplication_number 1 to 1001, count); the last slot has all above 1000."""
    slots = kept.sparkSession.range(1, DUPLICATION_SLOTS + 1).select(F.col("id").cast("int").alias("duplication_number"))
    counted = kept.where("UMI is not null").groupBy(F.least("n", F.lit(DUPLICATION_SLOTS)).cast("int").alias("duplication_number")).agg(F.count("*").alias("count"))
    return slots.join(counted, "duplication_number", "left").na.fill(0, ["count"])


def dedup_statistics(kept: DataFrame, dropped: DataFrame | None, cells: DataFrame) -> DataFrame:
    """Per cell: filtered_gene, corrected_UMI, and shares of the bases, which the report has always as 0."""
    out = cells.select("cell_id").distinct().join(kept.groupBy("cell_id").agg(F.sum("corrected").alias("corrected_UMI")), "cell_id", "left")
    out = out.join(dropped, "cell_id", "left") if dropped is not None else out.withColumn("filtered_gene", F.lit(0).cast("long"))
    return out.select("cell_id", F.coalesce("filtered_gene", F.lit(0)).alias("filtered_gene"), F.coalesce("corrected_UMI", F.lit(0)).alias("corrected_UMI"), *[F.lit(0.0).alias(f"{base}_prop") for base in "ATGC"])


def count_matrix(counts: DataFrame, cells: list[str]) -> DataFrame:
    """Genes × cells with zeros, in the order of ``cells``; for sinks only."""
    return counts.groupBy("gene_id").pivot("cell_id", cells).agg(F.sum("n")).na.fill(0)


def count_genes(reads: DataFrame, cells: DataFrame, mode: int = 2, gene_filter: bool = False, compat: bool = False) -> dict[str, DataFrame]:
    """counts, duplication and statistics of a table of cell reads."""
    pairs, dropped = pair_counts(reads), None
    if gene_filter:
        pairs, dropped = low_gene_filter(pairs)
    kept = corrected_pairs(pairs, mode, compat)
    return {"counts": gene_counts(kept), "duplication": duplication_histogram(kept), "statistics": dedup_statistics(kept, dropped, cells)}
