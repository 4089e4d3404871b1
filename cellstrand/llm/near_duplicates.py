"""N-gram Jaccard join by MinHash banding, and the classes of near duplicates.

Texts are lower-cased and split at ASCII white space; a document is the set of its
five-word shingles (a text of fewer words is one shingle).  Two documents link
when their sets' Jaccard similarity is at least 0.8.

1.  One pass over the texts writes a signature per document: a 128-bit hash of its
    words, the number of shingles and one key per band.  Bands and rows follow
    from the target recall (`choose_bands`).
2.  Equal texts meet in one aggregate, so copies, however many, are one node.
3.  Nodes meet in the buckets of their band keys.  A bucket's size and smallest
    member come from an aggregate with map-side combining.  First every member is
    compared with the smallest one; connected components follow.  Then what could
    still be missing is compared: in buckets of up to `all_pairs` members every
    pair; for the members of larger buckets with several classes, the pairs of
    different classes that share a rare shingle (`rare_shingles`): two sets at 0.8
    must share one of the rarest fifth of each.  Pairs left out join two members of
    one class or can't reach the similarity, so the classes are those of all
    candidate pairs, and neither copies nor documents with common passages are ever
    expanded into all their pairs.
4.  Each candidate pair is verified on the two full shingle sets.
5.  Links never leave a class, so their number is exact: within each class every two
    texts are compared (`compared`), whatever the size of their buckets.  Large
    classes are dealt into blocks, each two blocks meet in one group, and a group is
    compared by matrix products.  That work grows with the square of a class, as the
    number of its links does; it is done only where links are asked for.

Nothing about documents goes to the driver.  Components are found by alternating
large-star and small-star steps on tables in the shared folder.

Defined cases: null or wordless texts link to nothing and are a class of their
own; rows with a null id get a null class; equal rows share a class; rows with
one id and several texts count as one document linked to all of theirs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, ids_to_join, map_rows, materialise, runtime_filters

_U64 = np.uint64


def choose_bands(similarity: float, recall: float, max_bands: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with
    which at most ``max_bands`` bands find a pair at ``similarity`` with ``recall``."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands <= max_bands:
            best = (bands, rows)
    return best


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.997
    max_bands: int = 32
    seed: int = 20240601
    #: Buckets up to this size are compared pair by pair to find the classes.
    all_pairs: int = 16
    #: Texts and shingles, on average, of a block of a class whose links are counted.
    block_texts: int = 256
    block_shingles: int = 400_000

    @property
    def bands_rows(self) -> tuple[int, int]:
        return choose_bands(self.similarity, self.recall, self.max_bands)

    @property
    def percent(self) -> int:
        return round(self.similarity * 100)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    x ^= x >> _U64(31)
    x *= _U64(0x7FB5D329728EA185)
    x ^= x >> _U64(27)
    x *= _U64(0x81DADEF4BC2DD44D)
    x ^= x >> _U64(33)
    return x


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words."""
    if not words:
        return np.empty(0, _U64)
    size = min(size, len(words))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, _U64)
    for k in range(size):
        out *= _U64(0x9E3779B97F4A7C15)
        out += one[k : k + n]
    return np.unique(mixed(out))


def minhash(shingles: np.ndarray, multiply: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Minimum of each 32-bit hash function over the shingles, in bounded blocks."""
    x = (shingles >> _U64(32)).astype(np.uint32)[:, None]
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, ((x[i : i + 512] ^ flip) * multiply).min(axis=0), out=least)
    return least


def signatures(df: DataFrame, settings: JoinSettings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (hash of the words), n (shingles), keys (one per band; null without words)."""
    bands, rows = settings.bands_rows

    def work():
        draw = np.random.default_rng(settings.seed)
        multiply = draw.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
        flip = draw.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)
        weights = draw.integers(0, 1 << 63, rows, np.uint64) | _U64(1)
        salt = draw.integers(0, 1 << 63, bands, np.uint64)

        def step(columns):
            ids, texts = columns
            out = {"id": ids, "text_key": [], "n": [], "keys": []}
            for text in texts:
                words = words_of(text)
                found = shingle_set(words, settings.words)
                out["n"].append(len(found))
                if not len(found):
                    out["text_key"].append(None)
                    out["keys"].append(None)
                    continue
                out["text_key"].append(xxhash.xxh3_128_digest(b" ".join(words)))
                least = minhash(found, multiply, flip).reshape(bands, rows).astype(_U64)
                out["keys"].append(mixed((least * weights).sum(axis=1, dtype=_U64) ^ salt).view(np.int64))
            return out

        return step

    rows_in = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(rows_in, work, "id long, text_key binary, n int, keys array<long>")


def shingle_sets(df: DataFrame, settings: JoinSettings) -> DataFrame:
    """(id, text) to (id, shingles): the sorted 64-bit hashes as bytes."""

    def work():
        def step(columns):
            ids, texts = columns
            return {"id": ids, "shingles": [shingle_set(words_of(t), settings.words).tobytes() for t in texts]}

        return step

    return map_rows(df.select("id", "text"), work, "id long, shingles binary")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, _U64), np.frombuffer(b, _U64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""
    percent = settings.percent

    def run(batches):
        for batch in batches:
            one, two = batch.column("a_set"), batch.column("b_set")
            keep = pa.array([similar(one[i].as_buffer(), two[i].as_buffer(), percent) for i in range(batch.num_rows)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)
        give_back()

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set")), "a")
    return both.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def rare_shingles(sets: DataFrame, settings: JoinSettings, scratch: Scratch) -> DataFrame:
    """(key, id, n, at, short): for each set the shared shingles among its rarest.

    In any common order two sets of similarity t share one of the first
    n - ceil(t n) + 1 of each; the smaller of the two even one of its first
    n - ceil(2 t / (1 + t) n) + 1 (``short``).  Rarest come first; those that no other
    set here has are counted off but need no row.  ``at`` is the number of shingles
    before.
    """

    def spread(batches):
        for batch in batches:
            hashes = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "s"])
        give_back()

    wide = sets.select("id", "shingles").mapInArrow(spread, "id long, s array<long>")
    rows = scratch.table(wide.select("id", F.size("s").alias("n"), F.explode("s").alias("key")), "spread")
    # written before the join, so that the rows of a common key can be dealt out there
    shared = scratch.table(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    order = Window.partitionBy("id").orderBy("df", "key")
    placed = rows.join(shared, "key").withColumns({"k": F.row_number().over(order), "common": F.count("*").over(Window.partitionBy("id"))})
    placed = placed.withColumn("at", F.col("n") - F.col("common") + F.col("k") - 1)
    first = lambda percent: F.col("n") - F.ceil(F.col("n") * percent).cast("int") + 1
    p = settings.percent
    kept = placed.where(F.col("at") < first(F.lit(p / 100.0 - 1e-9)))
    return kept.select("key", "id", "n", "at", (F.col("at") < first(F.lit(2.0 * p / (100 + p) - 1e-9))).alias("short"))


def between_classes(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different classes with a rare shingle in common, from
    (key, id, n, at, short, class), that may still be similar enough.

    One side is always outside the class of the key's first member, so a key whose
    members are one class makes no pair.  The smaller side comes by its ``short``
    shingles only.  From the first shingle in common on, the sets can share no more
    than the shorter remainder; pairs that this rules out are not made.
    """
    first = rows.groupBy("key").agg(F.min(F.struct("id", "class")).alias("first"), F.count_if("short").alias("shorts"), F.min("class").alias("least"), F.max("class").alias("most"))
    # keys of one class, or without a short side, make no pair
    first = scratch.table(first.where("least <> most and shorts > 0").select("key", F.col("first.class").alias("first_class")), "first")
    marked = scratch.table(rows.join(first, "key").withColumn("outside", F.col("class") != F.col("first_class")), "marked")
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "at", "class", "outside")])
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    near = F.col("x_n") * 100 >= F.col("y_n") * percent
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = left * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    on = smaller & near & enough & (F.col("x_class") != F.col("y_class"))
    short = marked.where("short")
    one = side(short.where("outside"), "x").join(side(marked, "y"), "key").where(on)
    two = side(short.where("not outside"), "x").join(side(marked.where("outside"), "y"), "key").where(on)
    return one.union(two).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, other than itself."""
    with Scratch() as scratch:
        return materialise(contracted(edges, a, b, max_rounds, scratch), "roots")


def contracted(edges: DataFrame, a: str, b: str, max_rounds: int, scratch: Scratch) -> DataFrame:
    """`components` by alternating star contraction; each round is written, so a lost executor
    repeats one round at most.
    """
    now = scratch.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = scratch.table(new.distinct(), "components")
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
    raise RuntimeError("components did not settle")


def found_classes(df: DataFrame, settings: JoinSettings, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signatures, texts, sets, roots): a row per document, per different text, the
    shingles of the documents that share a bucket, and the `components` of the links."""
    sig = scratch.table(signatures(df, settings, id_col, text_col), "signatures")
    grouped = (
        sig.where("id is not null and n > 0")
        .groupBy("text_key")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by(F.struct("n", "keys"), "id").alias("s"))
    )
    texts = scratch.table(grouped.select("text_key", "id", "copies", "s.n", "s.keys"), "texts")
    with Scratch() as own:
        rows = texts.select("id", "n", F.explode("keys").alias("key"))
        # written before the join, so that the members of a crowded bucket can be dealt out there
        buckets = own.table(rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first")).where("size > 1"), "buckets")
        members = own.table(
            rows.join(buckets, "key").select("key", "id", "n", "size", F.col("first.id").alias("first"), F.col("first.n").alias("first_n")), "members"
        )
        wanted = own.table(members.select("id").distinct(), "wanted")
        bodies = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
        with runtime_filters(df.sparkSession):
            sets = scratch.table(shingle_sets(bodies.join(ids_to_join(wanted), "id", "left_semi"), settings), "shingles")
        fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * settings.percent) & (F.col(y) * 100 >= F.col(x) * settings.percent)

        to_first = members.where((F.col("id") != F.col("first")) & fits("n", "first_n")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        tried = own.table(to_first, "pairs")
        links = own.table(verify(tried, sets, settings), "links")
        roots = own.table(contracted(links, "a", "b", 60, own), "roots")

        classed = (
            members.join(roots.select(F.col("node").alias("id"), F.col("root")), "id", "left")
            .join(roots.select(F.col("node").alias("first"), F.col("root").alias("first_root")), "first", "left")
            .select("key", "id", "n", "size", F.coalesce("root", "id").alias("class"), F.coalesce("first_root", "first").alias("first_class"))
        )
        classed = own.table(classed, "classed")
        x = classed.where(F.col("size") <= settings.all_pairs)
        y = x.select("key", F.col("id").alias("b"), F.col("n").alias("b_n"))
        small = x.select("key", F.col("id").alias("a"), F.col("n").alias("a_n")).join(y, "key").where((F.col("a") < F.col("b")) & fits("a_n", "b_n")).select("a", "b")
        crowded = classed.where(F.col("size") > settings.all_pairs)
        mixed_keys = own.table(crowded.where("class <> first_class").select("key").distinct(), "mixed")
        mixed_ids = own.table(crowded.join(mixed_keys, "key", "left_semi").groupBy("id").agg(F.min("class").alias("class")), "crowded")
        rare = rare_shingles(sets.join(mixed_ids, "id", "left_semi"), settings, own).join(mixed_ids, "id")
        large = between_classes(own.table(rare, "rare"), settings.percent, own)
        rest = small.union(large).where("a <> b").distinct().join(tried, ["a", "b"], "left_anti")
        links = own.table(links.union(verify(rest, sets, settings)), "links")
        return sig, texts, sets, scratch.table(contracted(links, "a", "b", 60, own), "roots")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each of ``xs`` shares with each of ``ys``, in bounded blocks."""
    rows = [(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side)) for side in (xs, ys)]
    common = np.intersect1d(rows[0][1], rows[1][1])
    total = np.zeros((len(xs), len(ys)), np.int64)
    placed = []
    for owner, values in rows:
        at = np.searchsorted(common, values)
        known = at < len(common)
        known[known] = common[at[known]] == values[known]
        order = np.argsort(at[known], kind="stable")
        placed.append((owner[known][order], at[known][order]))
    for start in range(0, len(common), columns):
        sides = []
        for side, (owner, at) in zip((xs, ys), placed, strict=True):
            low, high = np.searchsorted(at, (start, start + columns))
            marks = np.zeros((len(side), min(columns, len(common) - start)), np.float32)
            marks[owner[low:high], at[low:high] - start] = 1
            sides.append(marks)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def linked(xs: list[np.ndarray], ys: list[np.ndarray], x_ids: np.ndarray, y_ids: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different x_ids, different y_ids, which of them link); ids are sorted, and an id
    with several sets links by any of them."""
    both = shared_counts(xs, ys)
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    found = (100 * both >= percent * (n[:, None] + m - both)) & (x_ids[:, None] != y_ids)
    one, two = np.unique(x_ids, return_index=True), np.unique(y_ids, return_index=True)
    if len(one[0]) < len(x_ids):
        found = np.logical_or.reduceat(found, one[1], axis=0)
    if len(two[0]) < len(y_ids):
        found = np.logical_or.reduceat(found, two[1], axis=1)
    return one[0], two[0], found


def dealt_classes(texts: DataFrame, roots: DataFrame, settings: JoinSettings) -> DataFrame:
    """(class, block, blocks, id, copies): the texts of classes of several, in blocks."""
    nodes = roots.select(F.col("node").alias("id"), F.col("root").alias("class")).union(roots.select("root", "root").distinct())
    by_id = texts.groupBy("id").agg(F.sum("copies").alias("copies"), F.sum("n").alias("n"))
    with Scratch() as own:
        nodes = own.table(nodes.join(by_id, "id"), "nodes")
        full = F.greatest(F.count("*") / settings.block_texts, F.sum("n") / settings.block_shingles)
        counts = own.table(nodes.groupBy("class").agg(F.ceil(full).cast("int").alias("blocks")), "blocks")
        placed = nodes.join(counts, "class").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        return materialise(placed.select("class", "block", "blocks", "id", "copies"), "dealt")


def compared(placed: DataFrame, sets: DataFrame, settings: JoinSettings, pairs: bool) -> DataFrame:
    """All links within the classes: as (a, b) with a < b if ``pairs``, or else for each
    text the number of documents that link to it, in parts (id, links).

    A class has as many blocks as its texts and shingles fill, by a hash of the id
    (`dealt_classes`); a row goes to the groups of its block with each block, so every two texts of a class
    meet in one group and no group is much larger than two blocks.
    """
    percent = settings.percent

    def run(batches):
        def compare(rows):
            blocks = {}
            for block, *row in rows:
                blocks.setdefault(block, []).append(row)
            sides = [blocks[k] for k in sorted(blocks)]
            if rows_apart and len(sides) < 2:  # the other block is empty
                return
            x, y = sides[0], sides[-1]
            ids = [np.array([r[0] for r in side], np.int64) for side in (x, y)]
            one, two, found = linked([r[2] for r in x], [r[2] for r in y], *ids, percent)
            if pairs:
                i, j = np.nonzero(found)
                a, b = one[i], two[j]
                if x is y:
                    a, b = a[a < b], b[a < b]
                made.append((np.minimum(a, b), np.maximum(a, b)))
                return
            copies = [dict((r[0], r[1]) for r in side) for side in (x, y)]
            weigh = lambda ids, k: np.array([copies[k][i] for i in ids.tolist()], np.int64)
            made.append((one, found @ weigh(two, 1)))
            if x is not y:
                made.append((two, weigh(one, 0) @ found))

        def out():
            columns = [pa.array(np.concatenate([m[k] for m in made]), pa.int64()) for k in (0, 1)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(names))

        made, rows, now, rows_apart = [], [], None, False
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("class", "i", "j")), strict=True))
            rest = list(zip(*(batch.column(c).to_pylist() for c in ("block", "id", "copies")), strict=True))
            bodies = batch.column("shingles")
            for k, key in enumerate(keys):
                if key != now:
                    if rows:
                        compare(rows)
                    if sum(len(m[0]) for m in made[-4096:]) >= 65536 or len(made) >= 4096:
                        yield out()
                    rows, now, rows_apart = [], key, key[1] != key[2]
                rows.append((*rest[k], np.frombuffer(bodies[k].as_py(), _U64)))
        if rows:
            compare(rows)
        if made:
            yield out()
        give_back()

    names = ("a", "b") if pairs else ("id", "links")
    bodies = placed.join(sets, "id")
    dealt = bodies.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "shingles")
    return dealt.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j", "block", "id").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def near_duplicate_classes(
    df: DataFrame, settings: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: id, class_id (smallest id of the class), n_links (copies of the same
    text and documents that a verified link joins to it), one row per input row.
    links: a, a_copies, b, b_copies: verified links between different texts, each
    text under its smallest id; made when read.
    """
    # the links are made when read, so these tables stay
    sig, texts, sets, roots = found_classes(df, settings, id_col, text_col, Scratch())
    copies = texts.select("id", "copies")
    named_copies = lambda side: copies.select(F.col("id").alias(side), F.col("copies").alias(f"{side}_copies"))
    placed = dealt_classes(texts, roots, settings)
    links = compared(placed, sets, settings, pairs=True).join(named_copies("a"), "a").join(named_copies("b"), "b").select("a", "a_copies", "b", "b_copies")
    linked_to = compared(placed, sets, settings, pairs=False).groupBy("id").agg(F.sum("links").alias("links"))
    nodes = (
        texts.select("text_key", "id", "copies")
        .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .join(linked_to, "id", "left")
        .select("text_key", F.coalesce("root", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    named = sig.where("id is not null and n > 0").select("id", "text_key").join(nodes, "text_key", "left").select("id", "class_id", "n_links")
    alone = sig.where("id is null or n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.union(alone), links


def class_members(df: DataFrame, settings: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and class_id of `near_duplicate_classes`, without the work of counting links."""
    with Scratch() as scratch:
        return materialise(_members(*found_classes(df, settings, id_col, text_col, scratch)), "classes")


def _members(sig: DataFrame, texts: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    nodes = texts.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("text_key", F.coalesce("root", "id").alias("class_id"))
    named = sig.where("id is not null and n > 0").select("id", "text_key").join(nodes, "text_key", "left").select("id", "class_id")
    return named.union(sig.where("id is null or n = 0").select("id", F.col("id").alias("class_id")))


def keep_one_of_each(df: DataFrame, settings: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their class: those with its smallest id.

    Rows with a null id stay.  Of rows with the same id one stays.
    """
    by_id = class_members(df, settings, id_col, text_col)
    by_id = by_id.where("id is not null").groupBy("id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("rows"))
    go = materialise(by_id.where("class_id <> id").select(F.col("id").alias(id_col)), "gone")
    kept = df.join(ids_to_join(go), id_col, "left_anti")
    again = by_id.where("rows > 1 and class_id = id").select(F.col("id").alias(id_col))
    if again.isEmpty():
        return kept
    return kept.join(again, id_col, "left_anti").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]))
