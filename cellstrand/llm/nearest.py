"""Approximate nearest neighbours by largest inner product.

A hierarchical k-means tree is fitted on a bounded sample and every vector is put
into one of its leaves.  A query walks the tree best bin first: a priority queue of
nodes by distance of their centre, popped until enough leaves are visited.  How
many are enough is calibrated, leaf by leaf, until the wanted recall is reached: for a
bounded number of queries against brute force over the whole table.  Inner products become distances by the usual
augmentation: each vector gets one more component that gives all the same norm.

The sample and with it the tree on the driver are bounded, so in a large table its
leaves are large.  Such a leaf is split further in the task that holds it: a tree of
its own vectors, walked and calibrated in the same way.  So leaves stay small and the
part of the vectors that a query is compared with falls as the table grows.

Neighbouring leaves form groups of bounded size.  A query goes once to each group in
which it visits leaves, with their numbers.  Groups with many vectors or many queries
are dealt out to blocks of bounded size, so neither a dense region nor equal vectors
make a task large.  A block returns its best for each query, ties within rounding
included; scores are exact double-precision sums in a fixed order.

Defined cases: vectors that are null, zero, of another length than most, or hold a
null or non-finite component take no part; ties go to the smaller id; rows of one id
count once, as a candidate by the one that scores best, as a query by the smallest
vector, and an id is never its own neighbour; components may be as large as doubles
are, and a product that is not a number counts as the smallest; with few candidates
more leaves are visited until there are enough or none is left; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, materialise


@dataclass(frozen=True)
class SearchSettings:
    k: int = 20
    sample_rows: int = 20_000
    branching: int = 8
    #: Sampled vectors in a leaf, about.
    leaf_rows: int = 24
    #: Leaves with more vectors than this in a block are split further there.
    split_rows: int = 1024
    #: What each of the two walks must find of the true neighbours in its calibration.
    recall: float = 0.955
    calibration_queries: int = 128
    block_vectors: int = 4096
    block_queries: int = 8192
    #: Queries of a task that walks the tree, about.
    walk_queries: int = 128
    seed: int = 5


class KMeansTree:
    """Nodes in arrays; node 0 is the root."""

    def __init__(self, x: np.ndarray, settings: SearchSettings) -> None:
        self.centres: list[np.ndarray] = [x.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        draw = np.random.default_rng(settings.seed)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= settings.leaf_rows:
                continue
            for centre, part in self._split(x, rows, settings.branching, draw):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), part))
                self.centres.append(centre)
                self.children.append([])
        self.points = np.stack(self.centres)
        self.squares = (self.points**2).sum(axis=1)
        leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf_of = {node: k for k, node in enumerate(leaves)}
        self.leaves = len(leaves)

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, k: int, draw: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        own = x[rows]
        distinct = np.unique(own[draw.permutation(len(own))[: 64 * k]], axis=0)
        if len(distinct) < 2:
            if (own == own[0]).all():
                return []
            distinct = np.stack([own[0], own[np.flatnonzero((own != own[0]).any(axis=1))[0]]])
        centres = distinct[draw.permutation(len(distinct))[:k]]
        for _ in range(12):
            near = (((centres**2).sum(axis=1))[None, :] - 2 * own @ centres.T).argmin(axis=1)
            centres = np.stack([own[near == c].mean(axis=0) for c in range(len(centres)) if (near == c).any()])
        near = (((centres**2).sum(axis=1))[None, :] - 2 * own @ centres.T).argmin(axis=1)
        parts = [(centres[c], rows[near == c]) for c in range(len(centres)) if (near == c).any()]
        return parts if len(parts) > 1 else []

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            near = (self.squares[kids][None, :] - 2 * x[rows] @ self.points[kids].T).argmin(axis=1)
            todo += [(kid, rows[near == c]) for c, kid in enumerate(kids) if (near == c).any()]
        return out

    def in_order(self) -> list[int]:
        """The leaves as they lie in the tree, so that neighbours are near each other."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += self.children[node]
            if not self.children[node]:
                out.append(self.leaf_of[node])
        return out

    def visit(self, q: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """Leaves in best-bin-first order: ``visits`` of them, and more until they hold ``least`` vectors."""
        far = self.squares - 2 * self.points @ q
        queue = [(0.0, 0)]
        out, held = [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if kids:
                for kid in kids:
                    heapq.heappush(queue, (far[kid], kid))
            else:
                leaf = self.leaf_of[node]
                if sizes[leaf]:
                    out.append(leaf)
                    held += int(sizes[leaf])
        return out


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def calibrate(tree: KMeansTree, x: np.ndarray, norm: float, settings: SearchSettings) -> int:
    """The fewest leaf visits that find the wanted part of the sample's true neighbours."""
    n = len(x)
    if n <= settings.k + 1:
        return tree.leaves
    queries = np.random.default_rng(settings.seed + 1).permutation(n)[: settings.calibration_queries]
    leaf = tree.assign(augmented(x, norm))
    sizes = np.bincount(leaf, minlength=tree.leaves)
    k = min(settings.k, n - 1)
    tops = []
    for i in queries:
        score = x @ x[i]
        score[i] = -np.inf
        tops.append(leaf[np.argpartition(-score, k - 1)[:k]])
    return enough_visits(tree, x[queries], tops, sizes, settings.recall)


def enough_visits(tree: KMeansTree, queries: np.ndarray, tops: list[np.ndarray], sizes: np.ndarray, recall: float) -> int:
    """The fewest visits with which the queries find that part of their true neighbours,
    whose leaves are given."""
    found = np.zeros(tree.leaves)
    for q, top in zip(queries, tops, strict=True):
        order = tree.visit(np.append(q, 0.0), tree.leaves, sizes, 0)
        place = np.full(tree.leaves, tree.leaves - 1)
        place[order] = np.arange(len(order))
        found += np.bincount(place[top], minlength=tree.leaves)
    reached = np.cumsum(found) >= recall * found.sum()
    return int(np.argmax(reached)) + 1 if found.sum() else tree.leaves


def calibrated(index: DataFrame, tree: KMeansTree, sizes: np.ndarray, scale: float, settings: SearchSettings) -> int:
    """`enough_visits` for some queries of the table against all of it.

    A pass over the vectors, in which a task keeps the best few for each query; queries
    have another hash order than the sample, so in large tables the tree was not fitted
    to them.
    """
    rows = index.orderBy(F.xxhash64("id", F.lit(settings.seed)), "id").limit(settings.calibration_queries).select("id", "v").toArrow()
    ids, q = rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks()) / scale
    k = settings.k

    def run(batches):
        best = [(np.empty(0), np.empty(0, np.int32)) for _ in ids]
        for batch in batches:
            x, own, leaf = _matrix(batch.column("v")) / scale, batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            for a in range(0, len(x), 4096):
                scores = q @ x[a : a + 4096].T
                scores[ids[:, None] == own[None, a : a + 4096]] = -np.inf
                for j, row in enumerate(scores):
                    both, leaves = np.concatenate([best[j][0], row]), np.concatenate([best[j][1], leaf[a : a + 4096]])
                    top = np.argpartition(-both, k - 1)[:k] if len(both) > k else np.arange(len(both))
                    best[j] = both[top], leaves[top]
        for j, (score, leaf) in enumerate(best):
            keep = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), j), pa.int32()), pa.array(leaf[keep], pa.int32()), pa.array(score[keep], pa.float64())], names=["j", "leaf", "score"])

    found = index.select("id", "leaf", "v").mapInArrow(run, "j int, leaf int, score double")
    first = Window.partitionBy("j").orderBy(F.desc("score"), "leaf")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("j", "leaf").collect()
    tops: list[list[int]] = [[] for _ in ids]
    for r in top:
        tops[r["j"]].append(r["leaf"])
    return enough_visits(tree, q, [np.array(t, np.int64) for t in tops], sizes, settings.recall)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        out = q @ x.T
    return np.nan_to_num(out, copy=False, nan=-np.finfo(float).max, posinf=np.inf, neginf=-np.finfo(float).max)


def split_leaf(x: np.ndarray, norm: float, settings: SearchSettings):
    """(order of the vectors, first of each part, walk) of a large leaf: a tree of its own
    vectors, and a function from a query to the parts it visits."""
    few = x[np.random.default_rng(settings.seed).permutation(len(x))[: settings.sample_rows]]
    tree = KMeansTree(augmented(few, norm), settings)
    visits = calibrate(tree, few, norm, settings)
    part = tree.assign(augmented(x, norm))
    sizes = np.bincount(part, minlength=tree.leaves)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(sizes)]), lambda q: tree.visit(np.append(q, 0.0), visits, sizes, settings.k + 1)


def rough_scores(x: np.ndarray, bounds: list[tuple[int, int, int]], q: np.ndarray, leaves: list[np.ndarray], inside: dict, scale: float) -> np.ndarray:
    """Products of some queries with the vectors of the leaves they visit, -inf elsewhere.

    ``bounds`` has leaf, first and last of the vectors, ``inside`` the leaves split further.
    """
    out = np.full((len(q), len(x)), -np.inf)
    asked = np.repeat(np.arange(len(q)), [len(v) for v in leaves])
    wanted = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
    order = np.argsort(wanted, kind="stable")
    asked, wanted = asked[order], wanted[order]
    for leaf, first, last in bounds:
        low, high = np.searchsorted(wanted, (leaf, leaf + 1))
        rows = asked[low:high]
        if not len(rows):
            continue
        if leaf not in inside:
            out[rows, first:last] = products(q[rows], x[first:last])
            continue
        starts, walk = inside[leaf]
        visited: dict[int, list[int]] = {}
        for r in rows.tolist():
            for part in walk(q[r] / scale):
                visited.setdefault(part, []).append(r)
        for part, those in visited.items():
            a, b = first + starts[part], first + starts[part + 1]
            out[those, a:b] = products(q[those], x[a:b])
    return out


def best_of_block(ids: np.ndarray, leaf: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, leaves: list[np.ndarray], scale: float, norm: float, settings: SearchSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the k best of each query, exact, an id once, ties to the smaller id."""
    k = settings.k
    order = np.lexsort((ids, leaf))
    ids, leaf, x = ids[order], leaf[order], x[order]
    cuts = np.flatnonzero(np.diff(leaf)) + 1
    bounds = [(int(leaf[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(leaf)], strict=True)]
    inside = {}
    for name, a, b in bounds:
        if b - a > settings.split_rows:
            own, starts, walk = split_leaf(x[a:b] / scale, norm, settings)
            ids[a:b], x[a:b] = ids[a:b][own], x[a:b][own]
            inside[name] = (starts, walk)
    out_q, out_i, out_s = [], [], []
    for a in range(0, len(q), 256):
        rough = rough_scores(x, bounds, q[a : a + 256], leaves[a : a + 256], inside, scale)
        rough[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        for j, row in enumerate(rough):
            near = np.flatnonzero(row > -np.inf)
            width = k
            while True:
                some = near
                if len(near) > width:
                    edge = np.partition(row[near], len(near) - width)[len(near) - width]
                    some = near[row[near] >= (edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else edge)]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (x[some] * q[a + j]).cumsum(axis=1)[:, -1]
                score = np.nan_to_num(score, nan=-np.finfo(float).max, posinf=np.inf, neginf=-np.inf)
                best = np.lexsort((ids[some], -score))
                _, first = np.unique(ids[some][best], return_index=True)
                best = best[np.sort(first)][:k]
                if len(best) == k or len(some) == len(near):
                    break
                width *= 4  # rows of one id took places
            out_q.append(np.full(len(best), query_ids[a + j]))
            out_i.append(ids[some][best])
            out_s.append(score[best])
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return join(out_q, np.int64), join(out_i, np.int64), join(out_s, np.float64)


def grouped_leaves(tree: KMeansTree, sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each leaf: neighbours together, as many as hold ``most`` vectors."""
    out, group, held = np.zeros(tree.leaves, np.int32), 0, 0
    for leaf in tree.in_order():
        if held and held + sizes[leaf] > most:
            group, held = group + 1, 0
        out[leaf] = group
        held += int(sizes[leaf])
    return out


def search(
    df: DataFrame, queries: str, settings: SearchSettings = SearchSettings(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each vector that the SQL condition ``queries`` (on ``id``) picks, its nearest
    others: query_id, rank (from 1), vec_id, score."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    out_schema = "query_id long, rank int, vec_id long, score double"
    picked = hash_sample(rows, "id", settings.sample_rows).select("v").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], out_schema)
    sample = _matrix(picked.column(0).combine_chunks())
    # all is scaled by the largest component, so that squares stay finite
    scale = float(rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])
    sample = sample / scale
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale)))
    norm = float(rows.agg(F.max(squared)).first()[0]) ** 0.5
    tree = KMeansTree(augmented(sample, norm), settings)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            leaf = tree.assign(augmented(x / scale, norm)) if len(x) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leaf, pa.int32()), batch.column("v")], names=["id", "leaf", "v"])

    index = materialise(rows.mapInArrow(place, "id long, leaf int, v array<double>"), "vectors")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    visits = calibrated(index, tree, sizes, scale, settings)
    group_of = grouped_leaves(tree, sizes, settings.block_vectors)
    groups = int(group_of.max()) + 1

    def walk(batches):
        for batch in batches:
            ids, vectors, asked_groups, asked_leaves = [], [], [], []
            for row, (i, q) in enumerate(zip(batch.column("id").to_pylist(), _matrix(batch.column("v")), strict=True)):
                leaves = np.array(tree.visit(np.append(q / scale, 0.0), visits, sizes, settings.k + 1), np.int32)
                where = group_of[leaves]
                for g in np.unique(where):
                    ids.append(i)
                    vectors.append(row)
                    asked_groups.append(g)
                    asked_leaves.append(leaves[where == g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column("v").take(pa.array(vectors, pa.int64())), pa.array(asked_groups, pa.int32()), pa.array(asked_leaves, pa.list_(pa.int32()))],
                names=["id", "v", "group", "leaves"],
            )

    # walks take milliseconds each, so tasks get few queries, whatever their bytes
    chosen = index.where(queries)
    once = chosen.repartition(chosen.count() // settings.walk_queries + 1, "id").groupBy("id").agg(F.min("v").alias("v"))
    asked = materialise(once.mapInArrow(walk, "id long, v array<double>, group int, leaves array<int>"), "queries")
    held, visited = np.bincount(group_of, sizes, groups).astype(np.int64), np.zeros(groups, np.int64)
    for r in asked.groupBy("group").count().collect():
        visited[r["group"]] = r["count"]
    parts = lambda counts, size: F.array(*[F.lit(int(-(-c // size)) or 1) for c in counts])
    of_vectors = F.element_at(parts(held, settings.block_vectors), F.col("group") + 1)
    of_queries = F.element_at(parts(visited, settings.block_queries), F.col("group") + 1)
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    grouped = index.withColumn("group", F.element_at(F.array(*[F.lit(int(g)) for g in group_of]), F.col("leaf") + 1))
    left = grouped.select("group", deal(of_vectors).alias("vb"), spread(of_queries).alias("qb"), "id", "leaf", "v")
    right = asked.select("group", spread(of_vectors).alias("vb"), deal(of_queries).alias("qb"), "id", "v", "leaves")

    def block(vectors: pa.Table, asked_: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked_.num_rows:
            found = [np.empty(0, t) for t in (np.int64, np.int64, np.float64)]
        else:
            x, q = (_matrix(t.column("v").combine_chunks()) for t in (vectors, asked_))
            to = [np.array(v, np.int64) for v in asked_.column("leaves").to_pylist()]
            found = best_of_block(vectors.column("id").to_numpy(), vectors.column("leaf").to_numpy(), x, asked_.column("id").to_numpy(), q, to, scale, norm, settings)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ("group", "vb", "qb")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score double")
    # an id whose rows lie in several blocks may come more than once
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")
