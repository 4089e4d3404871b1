"""Long-form (feature, barcode, n) matrices: scaling, reduction, neighbours, communities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.storage import written


def tf_idf(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """(feature, barcode, value): log1p(share of the cell × cells over the feature's sum × scale).

    Cells and features are summed and held against the counts, which are written once for that.
    """
    counts = written(counts, "counts")
    cell = counts.groupBy("barcode").agg(F.sum("n").alias("_cell"))
    feature = counts.groupBy("feature").agg(F.sum("n").alias("_feature"))
    cells = cell.agg(F.count("*").alias("_cells"))
    joined = counts.join(cell, "barcode").join(feature, "feature").crossJoin(F.broadcast(cells))
    tf = F.col("n") / F.nullif(F.col("_cell"), F.lit(0))
    idf = F.col("_cells") / F.nullif(F.col("_feature"), F.lit(0))
    return joined.select("feature", "barcode", F.coalesce(F.log1p(tf * idf * scale), F.lit(0.0)).alias("value"))


def counts_per_million(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("barcode"))
    return counts.select("feature", "barcode", (F.col("n") * 1e6 / F.nullif(total, F.lit(0))).alias("value"))


def log_normalised(counts: DataFrame) -> DataFrame:
    """log2(count over size factor + 1); size factors are cell totals over their mean."""
    totals = counts.groupBy("barcode").agg(F.sum("n").alias("_t"))
    mean = totals.agg(F.avg("_t").alias("_m"))
    joined = counts.join(totals, "barcode").crossJoin(F.broadcast(mean))
    return joined.select("feature", "barcode", F.log2(F.col("n") * F.col("_m") / F.nullif(F.col("_t"), F.lit(0)) + 1).alias("value"))


def feature_variance(values: DataFrame) -> DataFrame:
    """(feature, mean, variance) over all cells, absent values being 0."""
    cells = values.select("barcode").distinct().agg(F.count("*").alias("_n"))
    sums = values.groupBy("feature").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    return sums.crossJoin(F.broadcast(cells)).select("feature", (s / n).alias("mean"), F.when(n > 1, (q - s * s / n) / (n - 1)).otherwise(0.0).alias("variance"))


def most_variable(values: DataFrame, top: int = 500) -> DataFrame:
    return feature_variance(values).orderBy(F.desc("variance"), "feature").limit(top)


def abundant_features(counts: DataFrame, mean_above: float = 1.1, cells_above: int = 5) -> DataFrame:
    """Counts of features whose mean over their cells and number of cells are high enough; cells without counts go."""
    kept = counts.where("n > 0").groupBy("feature").agg(F.avg("n").alias("m"), F.count("*").alias("c")).where((F.col("m") > mean_above) & (F.col("c") > cells_above))
    return counts.where("n > 0").join(kept.select("feature"), "feature", "left_semi")


def products(rows: DataFrame, one: str, two: str) -> np.ndarray:
    """The small matrix of products of two columns of equally long arrays, summed over all
    rows: each task sums its own, so only matrices of that size travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (0, 1))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = rows.select(F.col(one).alias("x"), F.col(two).alias("y")).mapInArrow(run, "i int, v array<double>")
    summed = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max((r["j"] for r in summed), default=-1), 1 + max((r["i"] for r in summed), default=-1)
    out = np.zeros((size[1], size[0]))
    for r in summed:
        out[r["i"], r["j"]] = r["v"]
    return out


def times(rows: DataFrame, column: str, matrix: np.ndarray, name: str) -> DataFrame:
    """A column of arrays, each multiplied by a small matrix, in batches of rows."""
    kept = [c for c in rows.columns if c != name]
    at = rows.columns.index(column)
    schema = StructType([*[rows.schema[c] for c in kept], StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                made = pa.array(list(x @ matrix), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(rows_at[c]) for c in kept], made], names=[*kept, name])

    rows_at = {c: k for k, c in enumerate(rows.columns)}
    return rows.mapInArrow(run, schema)


def orthonormal(rows: DataFrame, column: str) -> DataFrame:
    """A column of arrays made orthonormal over the rows, by their product matrix, twice
    for the digits that the first time loses; directions that vanish are dropped."""
    for _ in range(2):
        d, v = np.linalg.eigh(products(rows, column, column))
        kept = d > 1e-13 * max(d.max(), 1e-300)
        rows = times(rows, column, v[:, kept] / np.sqrt(d[kept]), column)
    return rows


def lsi(values: DataFrame, rank: int = 50, rounds: int = 6, seed: int = 3) -> DataFrame:
    """(barcode, scores): V·D of a truncated singular value decomposition.

    Block power iteration on the cell side: each round multiplies the long matrix and
    its transpose with a (cells × rank) block, a table like any other, that is written.
    Only matrices of rank × rank come to the driver.  A cell's values lie in one file, so its
    sums travel once; the features' block is written before the long matrix meets it, so the
    matrix stays where it is if that block is small.
    """
    values = written(values.select("feature", "barcode", "value").repartition("barcode"), "values")
    sizes = values.agg(F.countDistinct("barcode").alias("cells"), F.countDistinct("feature").alias("features")).first()
    cells = values.select("barcode").distinct()
    k = max(min(rank, sizes["cells"], sizes["features"]) - 1, 0)
    if k == 0:
        return cells.withColumn("scores", F.array().cast("array<double>"))
    wide = min(k + 6, sizes["cells"])  # a few columns more settle sooner
    uniform = lambda j, salt: (F.pmod(F.xxhash64("barcode", j, F.lit(seed + salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda j: F.sqrt(-2 * F.log(uniform(j, 0))) * F.cos(2 * math.pi * uniform(j, 1))
    block = cells.withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), normal))
    for _ in range(rounds):
        used = written(orthonormal(written(block, "block"), "b"), "block")
        width = len(used.first()["b"])
        summed = F.array(*[F.sum(F.col("value") * F.col("b")[j]) for j in range(width)])
        up = written(values.join(used, "barcode").groupBy("feature").agg(summed.alias("b")), "block")
        block = values.join(up, "feature").groupBy("barcode").agg(summed.alias("b"))
    # within the last block the small eigenproblem gives the squared singular values
    both = written(used.withColumnRenamed("b", "used").join(block, "barcode"), "block")
    inner = products(both, "used", "b")
    vals, vecs = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-vals)[:k]
    scores = times(both, "used", vecs[:, order] * np.sqrt(np.maximum(vals[order], 0)), "scores").select("barcode", "scores")
    # of each direction the largest score is positive
    largest = scores.agg(*[F.max_by(F.col("scores")[j], F.struct(F.abs(F.col("scores")[j]), "barcode")).alias(str(j)) for j in range(len(order))]).first()
    signs = F.array(*[F.lit(-1.0 if x < 0 else 1.0) for x in largest])
    return scores.select("barcode", F.zip_with("scores", signs, lambda x, s: x * s).alias("scores"))


def principal_components(values: DataFrame, genes: DataFrame, rank: int = 10) -> DataFrame:
    """(barcode, scores): the first principal components of some genes' centred values.

    A cell is one array over the genes (some hundreds: the most variable); the product
    matrix of the genes is summed over cells and decomposed on the driver.
    """
    names = [r[0] for r in genes.select("feature").distinct().orderBy("feature").collect()]
    if not names:
        return values.select("barcode").distinct().withColumn("scores", F.array().cast("array<double>"))
    index = F.array_position(F.lit(names), F.col("feature")).cast("int") - 1
    wide = values.join(F.broadcast(genes.select("feature").distinct()), "feature").select("barcode", F.struct(index.alias("i"), "value").alias("x"))
    held = wide.groupBy("barcode").agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    full = values.select("barcode").distinct().join(held, "barcode", "left")
    cell = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    rows = written(full.select("barcode", cell.alias("x"), F.array(F.lit(1.0)).alias("one")), "cells")
    n = rows.count()
    if not n:
        return rows.select("barcode", F.array().cast("array<double>").alias("scores"))
    mean = products(rows, "one", "x")[0] / n
    cov = (products(rows, "x", "x") - n * np.outer(mean, mean)) / max(n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    top = vecs[:, np.argsort(-vals)[:rank]]
    top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1, 1)
    centre = F.array(*[F.lit(float(x)) for x in mean @ top])
    return times(rows, "x", top, "scores").select("barcode", F.zip_with("scores", centre, lambda x, c: x - c).alias("scores"))


def gene_tree(values: DataFrame, genes: DataFrame) -> DataFrame:
    """(step, one, two, height): average-linkage clustering of some genes by 1 - correlation.

    Genes are some hundreds, so their correlations are a small matrix; members of a merge
    are named by their smallest gene.
    """
    names = [r[0] for r in genes.select("feature").distinct().orderBy("feature").collect()]
    few = values.join(F.broadcast(genes.select("feature").distinct()), "feature")
    n = values.select("barcode").distinct().count()
    x = few.select("barcode", F.col("feature").alias("a"), F.col("value").alias("x"))
    pairs = x.join(few.select("barcode", F.col("feature").alias("b"), F.col("value").alias("y")), "barcode").where("a <= b")
    products_ = {(r["a"], r["b"]): r["s"] for r in pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()}
    sums = {r["a"]: r["s"] for r in x.groupBy("a").agg(F.sum("x").alias("s")).collect()}
    at = {g: i for i, g in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for (a, b), s in products_.items():
        cov[at[a], at[b]] = cov[at[b], at[a]] = s
    mean = np.array([sums.get(g, 0.0) for g in names]) / max(n, 1)
    cov -= n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    far = 1 - cov / np.outer(spread, spread)
    groups = {i: 1 for i in range(len(names))}
    out = []
    while len(groups) > 1:
        live = np.array(sorted(groups))
        part = far[np.ix_(live, live)] + np.where(np.eye(len(live), dtype=bool), np.inf, 0)
        i, j = divmod(int(part.argmin()), len(live))
        a, b = sorted((int(live[i]), int(live[j])))
        out.append((len(out) + 1, names[a], names[b], float(far[a, b])))
        joined = (groups[a] * far[a] + groups[b] * far[b]) / (groups[a] + groups[b])
        far[a], far[:, a] = joined, joined
        groups[a] += groups.pop(b)
    return values.sparkSession.createDataFrame(out, "step int, one string, two string, height double")


def nearest_of(x: np.ndarray, names: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, tile: int = 4096, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y for each row of x, equals by name.

    Tiles of ``rows`` by ``tile`` are looked at, so memory does not depend on the sizes.  A
    tile's products say which could be among the k nearest; those get their own difference.
    """
    place = np.empty(len(others), np.int64)
    place[np.argsort(others, kind="stable")] = np.arange(len(others))
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    out = []
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for to in range(0, len(y), tile):
            d = xx[at : at + rows, None] + yy[None, to : to + tile] - 2 * part @ y[to : to + tile].T
            if d.shape[1] > k:
                # products lose digits that differences keep
                slack = 1e-10 * (xx[at : at + rows] + yy[to : to + tile].max()) + 1e-300
                i, j = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None])
            else:
                i, j = (m.ravel() for m in np.indices(d.shape))
            far = np.concatenate([np.sqrt(((part[i[s : s + 65536]] - y[to + j[s : s + 65536]]) ** 2).sum(1)) for s in range(0, len(i), 65536)])
            far[names[at + i] == others[to + j]] = 0
            i, j, far = (np.concatenate(m) for m in zip(best, (i, to + j, far), strict=True))
            order = np.lexsort((place[j], far, i))
            i, j, far = i[order], j[order], far[order]
            first = np.searchsorted(i, i, side="left")
            kept = np.arange(len(i)) - first < k
            best = i[kept], j[kept], far[kept]
        out.append((best[0] + at, best[1], best[2]))
    return tuple(np.concatenate(m) for m in zip(*out, strict=True))


def nearest_cells(scores: DataFrame, k: int = 30, block: int = 4096, wide: int = 65536) -> DataFrame:
    """(barcode, rank, neighbour, distance), itself among them, by exact distance.

    Cells are dealt out to blocks, and more coarsely to wide blocks of candidates; every
    pair of a block and a wide one is one group, so a task holds two blocks whatever the
    number of cells, and returns k per cell.
    """
    n = scores.count()
    if n == 0:
        return scores.sparkSession.createDataFrame([], "barcode string, rank int, neighbour string, distance double")
    parts, wides = max(1, -(-n // block)), max(1, -(-n // wide))
    dealt = lambda m: F.pmod(F.xxhash64("barcode"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = scores.select("barcode", "scores", dealt(parts).alias("a"), each(wides).alias("b"))
    right = scores.select("barcode", "scores", dealt(wides).alias("b"), each(parts).alias("a"))
    kind = scores.schema["barcode"].dataType.simpleString()
    name = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([("barcode", name), ("neighbour", name), ("distance", pa.float64())])

    def near(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        x, y = (t.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (one, two))
        names, others = (t.column("barcode").to_numpy() for t in (one, two))
        i, j, far = nearest_of(x, names, y, others, k)
        return pa.Table.from_arrays([one.column("barcode").take(pa.array(i)), two.column("barcode").take(pa.array(j)), pa.array(far)], schema=schema)

    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(near, f"barcode {kind}, neighbour {kind}, distance double")
    order = Window.partitionBy("barcode").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("barcode", "rank", "neighbour", "distance")


def louvain(edges: list[tuple[str, str, float]], seed: int = 1) -> dict[str, int]:
    """Communities of an undirected graph by modularity, in a fixed order; numbered from 1."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    member = {x: i for i, x in enumerate(names)}
    weights: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    for a, b, w in edges:
        i, j = member[a], member[b]
        weights[i][j] = weights[i].get(j, 0.0) + w
        if i != j:
            weights[j][i] = weights[j].get(i, 0.0) + w
    group = list(range(len(names)))
    while True:
        n = len(weights)
        degree = {i: sum(w.values()) + w.get(i, 0.0) for i, w in weights.items()}
        total = sum(degree.values()) or 1.0
        com, inside = {i: i for i in weights}, dict(degree)
        moved_any = False
        order = np.random.default_rng(seed).permutation(n).tolist()
        for _ in range(50):
            moved = False
            for i in order:
                own = com[i]
                inside[own] -= degree[i]
                links: dict[int, float] = {}
                for j, w in weights[i].items():
                    if j != i:
                        links[com[j]] = links.get(com[j], 0.0) + w
                gain = lambda c: links.get(c, 0.0) - inside[c] * degree[i] / total  # noqa: B023, E731
                best = max(sorted({own, *links}), key=lambda c: (gain(c), c == own))
                inside[best] += degree[i]
                com[i] = best
                moved |= best != own
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        renum = {c: k for k, c in enumerate(sorted(set(com.values())))}
        group = [renum[com[g]] for g in group]
        merged: dict[int, dict[int, float]] = {k: {} for k in renum.values()}
        for i, w in weights.items():
            for j, x in w.items():
                if i <= j:
                    a, b = renum[com[i]], renum[com[j]]
                    merged[a][b] = merged[a].get(b, 0.0) + x
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + x
        if len(merged) == n:
            break
        weights = merged
    first: dict[int, int] = {}
    return {x: first.setdefault(group[i], len(first) + 1) for i, x in enumerate(names)}


def moved_labels(edges: DataFrame, rounds: int = 8, seed: int = 4) -> DataFrame:
    """(node, label): nodes of a weighted graph (a, b, weight; a <= b) moved, round by round,
    to the neighbouring community that gains modularity most.

    Half of the nodes, by a hash, may move in a round, so neighbours don't swap places
    for ever.  Joins and aggregates only; labels are written each round.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    degree = written(ends.groupBy("node").agg(F.sum("weight").alias("degree")), "degrees")
    between = written(ends.where("node <> other"), "ends")
    whole = degree.agg(F.sum("degree")).first()[0] or 1.0
    labels = degree.select("node", "degree", F.col("node").alias("label"))
    for k in range(rounds):
        held = labels.groupBy("label").agg(F.sum("degree").alias("held"))
        near = between.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("links"))
        stay = labels.select("node", "label", F.lit(0.0).alias("links"))
        tried = near.unionByName(stay).groupBy("node", "label").agg(F.sum("links").alias("links"))
        own = labels.select("node", "degree", F.col("label").alias("own"))
        scored = tried.join(held, "label").join(own, "node")
        rest = F.col("held") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("links") - F.col("degree") * rest / whole, 9)
        best = scored.groupBy("node", "degree", "own").agg(F.max_by("label", F.struct(gain, F.col("label") == F.col("own"), "label")).alias("best"))
        free = F.pmod(F.xxhash64("node", F.lit(seed + k)), F.lit(2)) == 0
        labels = written(best.select("node", "degree", F.when(free, F.col("best")).otherwise(F.col("own")).alias("label")), "labels")
    return labels.select("node", "label")


def clusters(neighbours: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """(barcode, cluster): communities of the neighbour graph.

    While the graph has more than ``most_edges`` edges its nodes are put together by
    `moved_labels`, communities becoming nodes; the graph that is left, whose size is
    bounded, is divided on the driver.
    """
    pairs = neighbours.where("barcode <> neighbour").select(F.least("barcode", "neighbour").alias("a"), F.greatest("barcode", "neighbour").alias("b")).distinct()
    edges = written(pairs.withColumn("weight", F.lit(1.0)), "edges")
    members = None
    size = edges.count()
    while size > most_edges:
        labels = moved_labels(edges)
        named = lambda c, labels=labels: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        joined = edges.join(named("a"), "a").join(named("b"), "b")
        fewer = written(joined.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight")), "edges")
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        members = labels if members is None else members.join(further, "label").select("node", F.col("next").alias("label"))
        members = written(members, "members")
        before, size, edges = size, fewer.count(), fewer
        if size > 0.9 * before:
            raise RuntimeError(f"the neighbour graph has no communities to put together: {size} edges are left")
    found = louvain([(r["a"], r["b"], r["weight"]) for r in edges.collect()])
    made = neighbours.sparkSession.createDataFrame(sorted(found.items()), "barcode string, cluster int")
    if members is None:
        return made
    return members.join(made.withColumnRenamed("barcode", "label"), "label").select(F.col("node").alias("barcode"), "cluster")


# The curve 1 / (1 + a d^2b) that stands for a least distance of 0.1 and a spread of 1.
CURVE_A, CURVE_B = 1.576943, 0.8950609


def _smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(barcode, names, weights) of (barcode, names, distances): how strongly each neighbour
    belongs, by a width at which the strengths sum to the logarithm of their number."""
    for batch in batches:
        made = []
        for distances in batch.column(2).to_pylist():
            d = np.array(distances, float)
            d = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0)
            low, high = 1e-12, max(1e-12, 64 * d.max())
            for _ in range(50):
                mid = (low + high) / 2
                low, high = (low, mid) if np.exp(-d / mid).sum() > math.log2(max(len(d), 2)) else (mid, high)
            made.append(np.exp(-d / high))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["barcode", "names", "weights"])


def fuzzy_edges(neighbours: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: the union of what both cells think of their nearness."""
    others = neighbours.where("barcode <> neighbour")
    lists = others.groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct("neighbour", "distance"))).alias("l"))
    lists = lists.select("barcode", F.col("l.neighbour").alias("names"), F.col("l.distance").alias("distances"))
    kind = others.schema["barcode"].dataType.simpleString()
    sided = lists.mapInArrow(_smooth, f"barcode {kind}, names array<{kind}>, weights array<double>")
    flat = sided.select("barcode", F.explode(F.arrays_zip("names", "weights")).alias("x")).select("barcode", F.col("x.names").alias("other"), F.col("x.weights").alias("w"))
    both = flat.groupBy(F.least("barcode", "other").alias("a"), F.greatest("barcode", "other").alias("b"))
    return both.agg((1 - F.exp(F.sum(F.log1p(-F.least("w", F.lit(1 - 1e-12)))))).alias("weight"))


def umap(neighbours: DataFrame, scores: DataFrame, epochs: int = 30, negatives: int = 5, group: int = 256, seed: int = 7) -> DataFrame:
    """(barcode, x, y): a layout in which neighbours attract and others repel each other.

    It starts from the first two reduced axes.  In an epoch edges pull by their weight,
    one join and one aggregate; for repulsion cells are dealt into new small groups by a
    hash, and each is pushed by a few others of its group.  Positions are a table that is
    written each epoch, so nothing grows on the driver.  Rows are bounded by the edges.
    """
    edges = written(fuzzy_edges(neighbours), "edges")
    pulls = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    axis = lambda k: F.coalesce(F.try_element_at("scores", F.lit(k)), F.lit(0.0))
    start = scores.select("barcode", axis(1).alias("x"), axis(2).alias("y"))
    reach = start.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    jitter = lambda salt: F.pmod(F.xxhash64("barcode", F.lit(seed + salt)), F.lit(1 << 20)) / float(1 << 20) * 0.01
    now = written(start.select("barcode", (F.col("x") * 10 / reach + jitter(0)).alias("x"), (F.col("y") * 10 / reach + jitter(1)).alias("y")), "layout")
    groups = max(1, now.count() // group)
    kind = now.schema["barcode"].dataType.simpleString()

    def push(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("barcode")
        y = pdf[["x", "y"]].to_numpy()
        moved = np.zeros_like(y)
        for k in range(1, min(negatives, len(y) - 1) + 1):
            gap = y - np.roll(y, k * max(1, len(y) // (negatives + 1)), axis=0)
            d = (gap**2).sum(axis=1, keepdims=True)
            moved += np.clip(2 * CURVE_B / ((0.001 + d) * (1 + CURVE_A * d**CURVE_B)) * gap, -4, 4)
        return pd.DataFrame({"barcode": pdf["barcode"], "dx": moved[:, 0], "dy": moved[:, 1]})

    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        other = now.select(F.col("barcode").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        met = pulls.join(now.withColumnRenamed("barcode", "a"), "a").join(other, "b")
        d = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        strength = F.when(d > 0, -2 * CURVE_A * CURVE_B * F.pow(d, CURVE_B - 1) / (1 + CURVE_A * F.pow(d, CURVE_B))).otherwise(0.0)
        clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
        pull = met.groupBy(F.col("a").alias("barcode")).agg(
            (F.sum(F.col("weight") * clip(strength * (F.col("x") - F.col("ox")))) / F.sum("weight")).alias("px"),
            (F.sum(F.col("weight") * clip(strength * (F.col("y") - F.col("oy")))) / F.sum("weight")).alias("py"),
        )
        away = now.groupBy(F.pmod(F.xxhash64("barcode", F.lit(seed + 10 + epoch)), F.lit(groups)).alias("g")).applyInPandas(push, f"barcode {kind}, dx double, dy double")
        joined = now.join(pull, "barcode", "left").join(away, "barcode", "left")
        step = lambda at, p, q: (F.col(at) + rate * (F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)) / negatives)).alias(at)
        now = written(joined.select("barcode", step("x", "px", "dx"), step("y", "py", "dy")), "layout")
    return now


def layout(scores: DataFrame, groups: DataFrame, cells: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Two coordinates (those of `umap` if given, else the first reduced axes), cluster and cell columns."""
    if places is None:
        places = scores.select("barcode", F.try_element_at("scores", F.lit(1)).alias("x"), F.try_element_at("scores", F.lit(2)).alias("y"))
    out = places.join(groups, "barcode", "left")
    return out.join(cells, "barcode", "left") if cells is not None else out
