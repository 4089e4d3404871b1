"""Mixing sources to target weights, with DataFrame functions only.

A document's size is its number of words.  Sources share the corpus's words by
weight; none may be taken more than `max_repeats` times, and what it can't take
is shared by the others (`targets`).

A hash of its id gives each document a place in [0, 1).  A source is cut into blocks
of places, as many as its documents call for, so block numbers are a random
permutation already.  A source's quota is a number of block draws: all its blocks once
a pass, and of the last pass the blocks up to the place at which the target is reached,
the last one in part, with the one document more that comes nearest to it.  That place
is found by digits of the hash (`last_places`): sums of 1,024 intervals, then of 1,024
within the one that holds it, and so on, so no window grows with the table.

The quotas are split among output shards by a binary tree: at each node half of the
node's draws go left, and how many of each source is drawn from the multivariate
hypergeometric distribution, one source after the other by its conditional
hypergeometric law.  Leaves hold disjoint runs of each source's draws.  A document is
taken once for every draw of its block that a leaf holds, and a hash orders it within
that shard; `shards` lays the rows out so.

Draws are hashes of ids and a seed, so reruns agree.  Beside the documents there are
tables of 1,024 rows a source and of one row a source; the latter is joined by the
optimizer's own choice.

Defined cases: a null or wordless text has size 0 and is taken with its block; a
null source is a source of its own, last in order; a null id is an id like others;
repeated rows are taken alike; an empty table gives an empty result; if all sizes
are 0 every target is 0 and nothing is taken; a source whose target is `max_repeats`
times its words is taken that often and no more, empty texts too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, materialise

#: Digits of a place have so many bits; a place has 60.
DIGIT_BITS = 10
PLACE_BITS = 60


@dataclass(frozen=True)
class MixSettings:
    #: Weights of the sources in code-point order, repeating.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeats: int = 3
    #: Documents of a block, about, and most blocks of a source.
    block_documents: int = 64
    most_blocks: int = 1 << 16
    #: Words of a shard, about, and levels of the splitting tree at least and at most.
    shard_words: int = 10_000_000
    least_levels: int = 4
    most_levels: int = 16
    #: Documents of an interval that are put in order without a further digit.
    interval_documents: int = 20_000
    seed: int = 17


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD.replace("\\x20", " "))), F.lit(0)).cast("long")


def _uniform(*parts: str) -> str:
    """SQL of a number in [0, 1) from a hash."""
    return f"(pmod(xxhash64({', '.join(parts)}), {1 << 53}L) / {float(1 << 53):.1f}D)"


def targets(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """(source, words) to (source, words, weight, target), by water filling.

    In the order of cap over weight the capped sources come first; a source is
    capped when its cap is at most its share of what those before it leave.  One
    row a source is sorted here, never documents.
    """
    n = len(settings.weights)
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in settings.weights]), (F.col("rank") % n + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("words") * F.lit(float(settings.max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = caps.withColumn("level", level).withColumn("place", F.row_number().over(order))
    open_place = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("place"))
    water = filled.withColumn("water", F.min_by("level", open_place).over(everything))
    return water.select("source", "words", "weight", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), "cap").alias("target"))


def _log_factorial(n: str) -> str:
    """SQL of Stirling's series eight places further on, and back by the product between."""
    x = f"cast(({n}) + 9 as double)"
    back = " * ".join(f"(({n}) + {k}D)" for k in range(1, 9))
    return f"((({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x})) - ln({back}))"


def hypergeometric(good: str, all_: str, drawn: str, u: str) -> str:
    """SQL of how many of ``drawn`` out of ``all_`` are among the ``good``: inversion of u.

    All but 1e-20 of the law lies within ten deviations of its mean, so of large
    numbers only those are looked at.
    """
    lf = _log_factorial
    fixed = f"({lf(good)} + {lf(f'{all_} - {good}')} + {lf(drawn)} + {lf(f'{all_} - {drawn}')} - {lf(all_)})"
    mass = f"exp(y.fixed - {lf('k')} - {lf(f'{good} - k')} - {lf(f'{drawn} - k')} - {lf(f'{all_} - {good} - {drawn} + k')})"
    rate = f"({good} / cast(nullif({all_}, 0) as double))"
    mean, reach = f"({drawn} * {rate})", f"(10 * sqrt({drawn} * {rate} * (1 - {rate})) + 20)"
    low = f"greatest(0L, {drawn} - ({all_} - {good}), cast(ceil({mean} - {reach}) as bigint))"
    high = f"least({good}, {drawn}, cast(floor({mean} + {reach}) as bigint))"
    begin = f"named_struct('k', {low}, 'p', 0D, 'fixed', {fixed}, 'u', {u})"
    step = f"(y, k) -> if(y.p > y.u, y, named_struct('k', k, 'p', y.p + {mass}, 'fixed', y.fixed, 'u', y.u))"
    return f"if({low} >= {high}, {low}, aggregate(sequence({low}, {high}), {begin}, {step}, y -> y.k))"


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, draws) to (source, shard, first, count): each source's draws, numbered
    from 0, dealt out to the shards in runs, every shard as large as its neighbours.

    At each node one source after the other is dealt: ``all`` are the draws of the
    sources to come, ``want`` what the left child still lacks.
    """
    root = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("draws").cast("long").alias("n")))).alias("held"))
    nodes = root.select(F.lit(0).cast("long").alias("node"), "held")
    for level in range(levels):
        nodes = nodes.selectExpr("node", "held", "aggregate(held, 0L, (a, x) -> a + x.n) as total")
        k = hypergeometric("x.n", "a.all", "a.want", _uniform("x.source", "node", str(level), str(seed)))
        begin = "named_struct('all', total, 'want', cast(floor((total + 1) / 2) as bigint), 'got', cast(array() as array<bigint>))"
        # the number is drawn once, in an array of one, and then used three times
        step = f"(a, x) -> transform(array({k}), g -> named_struct('all', a.all - x.n, 'want', a.want - g, 'got', concat(a.got, array(g))))[0]"
        nodes = nodes.selectExpr("node", "held", f"aggregate(held, {begin}, {step}, a -> a.got) as got")
        child = lambda n, of: f"named_struct('node', {n}, 'held', zip_with(held, got, (x, g) -> named_struct('source', x.source, 'n', {of})))"
        nodes = nodes.selectExpr(f"inline(array({child('node * 2', 'g')}, {child('node * 2 + 1', 'x.n - g')}))")
    dealt = nodes.select(F.col("node").alias("shard"), F.explode("held").alias("x")).select("x.source", "shard", F.col("x.n").alias("count"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select("source", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("first"), "count")


def _named(x: DataFrame, y: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on the source, nulls being one."""
    return x.join(y.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")), how).drop("its")


def _small(df: DataFrame) -> DataFrame:
    """A table of few rows a source, to be written as one file."""
    return df.repartition(1)


def _digit(place: str, k: int) -> Column:
    return F.shiftright(F.col(place), PLACE_BITS - DIGIT_BITS * (k + 1)).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")


def _crossed(sums: DataFrame, key: str) -> DataFrame:
    """(source, at, left, documents) of (source, key, left, words, documents): the first
    key up to which the words exceed ``left``, and what is left before it."""
    run = Window.partitionBy("source").orderBy(key)
    summed = sums.withColumn("until", F.sum("words").over(run))
    first = F.min(F.when(F.col("until") > F.col("left"), F.struct(F.col(key).alias("at"), (F.col("left") - F.col("until") + F.col("words")).alias("left"), "documents")))
    return summed.groupBy("source").agg(first.alias("x")).select("source", "x.at", "x.left", "x.documents")


def last_places(sizes: DataFrame, sums: DataFrame, goal: DataFrame, settings: MixSettings, scratch: Scratch) -> DataFrame:
    """(source, cut, short): the last place whose document still fits into what the last
    pass takes, and by how many words it falls short; sources without last pass have none.

    ``sizes`` has source, place and size, ``sums`` the words and documents of each first
    digit, ``goal`` the words that the last pass takes (rest).
    """
    wanted = goal.where("rest > 0").select("source", F.col("rest").alias("left"))
    found = scratch.table(_small(_crossed(_named(sums, wanted), "digit").select("source", F.col("at").cast("long").alias("prefix"), "left", "documents")), "mix-digit")
    digits = 1
    inside = lambda: _named(sizes, found.select("source", "prefix", "left")).where(F.shiftright("place", PLACE_BITS - DIGIT_BITS * digits) == F.col("prefix"))
    while DIGIT_BITS * (digits + 1) <= PLACE_BITS and (found.agg(F.max("documents")).first()[0] or 0) > settings.interval_documents:
        by = inside().groupBy("source", "prefix", "left", _digit("place", digits).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("documents"))
        next_ = _crossed(by, "digit")
        found = scratch.table(_small(_named(found.select("source", "prefix"), next_).select("source", (F.col("prefix") * (1 << DIGIT_BITS) + F.col("at")).alias("prefix"), "left", "documents")), "mix-digit")
        digits += 1
    at = inside().groupBy("source", "prefix", "left", "place").agg(F.sum("size").alias("words"))
    at = at.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("place")))
    fits = F.col("until") <= F.col("left")
    before = F.shiftleft(F.col("prefix"), PLACE_BITS - DIGIT_BITS * digits) - 1
    cut = at.groupBy("source", "prefix", "left").agg(F.max(F.when(fits, F.col("place"))).alias("cut"), F.max(F.when(fits, F.col("until"))).alias("words"))
    return cut.select("source", F.coalesce("cut", before).alias("cut"), (F.col("left") - F.coalesce("words", F.lit(0))).alias("short"))


def plan(sizes: DataFrame, settings: MixSettings) -> tuple[DataFrame, int]:
    """As `planned`, its own tables removed."""
    with Scratch() as scratch:
        made, levels = planned(sizes, settings, scratch)
        return materialise(_small(made), "mix-plan"), 2**levels


def planned(sizes: DataFrame, settings: MixSettings, scratch: Scratch) -> tuple[DataFrame, int]:
    """(plan, levels of the tree).  The plan has one row a source: words, target, blocks, passes, the place where the last pass ends,
    the document taken beyond it, and the runs of draws of its shards.

    ``sizes`` has source, size and place, a row a document.
    """
    sums = sizes.groupBy("source", _digit("place", 0).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("documents"))
    sums = scratch.table(_small(sums), "mix-sums")
    totals = sums.groupBy("source").agg(F.sum("words").alias("words"), F.sum("documents").alias("documents"))
    goal = _named(targets(totals.select("source", "words"), settings), totals.select("source", "documents"))
    passes = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("words"), F.lit(0))).cast("long"), F.lit(0).cast("long"))
    goal = goal.withColumn("passes", F.least(passes, F.lit(settings.max_repeats)))
    # a source taken as often as may be has no last pass, whatever rounding leaves
    rest = F.when(F.col("passes") < settings.max_repeats, F.greatest(F.col("target") - F.col("passes") * F.col("words"), F.lit(0.0))).otherwise(F.lit(0.0))
    blocks = F.greatest(F.lit(1), F.least(F.lit(settings.most_blocks), F.ceil(F.col("documents") / settings.block_documents))).cast("long")
    goal = scratch.table(_small(goal.withColumns({"rest": rest, "blocks": blocks})), "mix-goal")
    cuts = scratch.table(_small(last_places(sizes, sums, goal, settings, scratch)), "mix-cut")
    # of the documents behind, the one that comes nearest to what is still short
    gap = F.abs(F.col("short") - F.col("size"))
    behind = _named(sizes, cuts).where((F.col("place") > F.col("cut")) & (gap < F.col("short")))
    extra = behind.groupBy("source").agg(F.min_by("place", F.struct(gap, F.col("place"))).alias("extra"))
    full = _named(_named(goal, cuts, "left"), extra, "left")
    last = F.when(F.col("cut") >= 0, _block("cut", "blocks") + 1).otherwise(F.when(F.col("extra").isNotNull(), 1).otherwise(0))
    full = scratch.table(_small(full.withColumn("draws", F.col("passes") * F.col("blocks") + F.coalesce(last, F.lit(0)))), "mix-full")
    words = goal.agg(F.sum("target")).first()[0] or 0.0
    levels = min(settings.most_levels, max(settings.least_levels, math.ceil(math.log2(max(1.0, words / settings.shard_words)))))
    tree = splitting_tree(full.select("source", "draws"), levels, settings.seed)
    runs = tree.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "count", "shard"))).alias("runs"))
    return _named(full, runs), levels


def _block(place: str, blocks: str) -> Column:
    """The block of a place: the places of a source in so many equal parts."""
    return F.floor(F.col(place) / F.lit(float(1 << PLACE_BITS)) * F.col(blocks)).cast("long")


def sized(df: DataFrame, settings: MixSettings, id_col: str, text_col: str, source_col: str, size: Column | None = None) -> DataFrame:
    """(row, mix): the row as it is, apart from what the operator adds."""
    return df.select(
        F.struct("*").alias("row"),
        F.struct(
            (size if size is not None else words_in(text_col)).alias("size"),
            F.col(source_col).cast("string").alias("source"),
            F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(settings.seed)), F.lit(1 << PLACE_BITS)).alias("place"),
        ).alias("mix"),
    )


def with_draws(rows: DataFrame, made: DataFrame, settings: MixSettings) -> DataFrame:
    """``rows`` (with the struct ``mix``) and ``draws``: (pass, shard, order) for each
    time a shard takes the row; also the source's words and target.

    The draws of a document are those of its block, one a pass, that lie in a shard's
    run; of the last pass's only if it does not lie behind the cut.
    """
    joined = rows.join(made.select(F.struct("*").alias("goal")), F.col("mix.source").eqNullSafe(F.col("goal.source")))
    block, passes, place = _block("mix.place", "goal.blocks"), F.col("goal.passes"), F.col("mix.place")
    behind = F.coalesce(place > F.col("goal.cut"), F.lit(True))
    extra = F.coalesce(place == F.col("goal.extra"), F.lit(False))

    def held(p: Column) -> Column:
        """The run that holds the block's draw of a pass; the one document more goes with the last draw."""
        q = F.when(extra & (p == passes), F.col("goal.draws") - 1).otherwise(p * F.col("goal.blocks") + block)
        run = F.filter("goal.runs", lambda r: (r["first"] <= q) & (q < r["first"] + r["count"]))
        order = F.xxhash64("mix.place", p, F.lit(settings.seed + 2))
        return F.transform(run, lambda r: F.struct(p.cast("int").alias("pass"), r["shard"].cast("int").alias("shard"), order.alias("order")))

    tried = F.sequence(F.lit(0).cast("long"), passes)
    draws = F.flatten(F.transform(tried, held))
    return joined.withColumn("draws", F.filter(draws, lambda d: (d["pass"] < passes) | ~behind | extra))


def mix(
    df: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per input row: id, size, source_size, target, draws (an array, a
    member for each time the row is taken, with its shard and order there)."""
    narrow = sized(df, settings, id_col, text_col, source_col).select(F.col("row")[id_col].alias("id"), "mix")
    narrow = materialise(narrow, "mix-sizes")
    made, _ = plan(narrow.select("mix.*"), settings)
    return with_draws(narrow, made, settings).select(
        F.col("id").alias(id_col), F.col("mix.size").alias("size"), F.col("goal.words").cast("long").alias("source_size"), F.col("goal.target").alias("target"), "draws"
    )


def shards(
    df: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(shard, order, row): the mixed rows, each shard a partition, shuffled within it."""
    narrow = materialise(sized(df, settings, id_col, text_col, source_col).select("mix"), "mix-sizes")
    made, number = plan(narrow.select("mix.*"), settings)
    # sizes are known by now and play no part in the draws
    rows = with_draws(sized(df, settings, id_col, text_col, source_col, F.lit(0).cast("long")), made, settings)
    out = rows.select("row", F.explode("draws").alias("draw")).select(F.col("draw.shard").alias("shard"), F.col("draw.order").alias("order"), "row")
    return out.repartitionById(number, F.col("shard")).sortWithinPartitions("shard", "order")


def mixed_rows(
    df: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, columns as they are, in
    the order of their `shards`."""
    return shards(df, settings, id_col, text_col, source_col).select("row.*")
