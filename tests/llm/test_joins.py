import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from cellstrand.llm import mixing, near_duplicates, nearest

from .conftest import SCHEMA, prose


def classes_of(texts):
    """Brute force: classes and link counts of {id: text}."""
    sets = {i: set(near_duplicates.shingle_set(near_duplicates.words_of(t), 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}
    links = collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
                    links[i] += 1
                    links[j] += 1
    return {i: find(i) for i in sets}, links


def test_bands_reach_the_recall():
    bands, rows = near_duplicates.choose_bands(0.8, 0.997, 32)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.997 and bands <= 32


def test_classes_are_brute_force(spark):
    draw = random.Random(6)
    texts = {}
    for family in range(14):
        words = prose(120, family).split()
        for k in range(draw.randint(1, 5)):
            changed = list(words)
            for _ in range(k):
                changed[draw.randrange(len(changed))] = f"new{draw.randint(0, 99)}"
            texts[len(texts)] = " ".join(changed)
    texts[len(texts)] = texts[0].upper()
    want, links = classes_of(texts)
    members, _ = near_duplicates.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r["id"]: r for r in members.collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in texts}


def test_crowded_buckets_lose_no_class(spark):
    """Many texts share most of a passage; buckets are far over the limit for all pairs."""
    draw = random.Random(7)
    passage = prose(70, 100)
    texts = {i: passage + " " + prose(12, 200 + i) for i in range(70)}
    for i in range(0, 30):
        words = texts[i].split()
        words[-1 - draw.randint(0, 3)] = "other"
        texts[100 + i] = " ".join(words)
    want, _ = classes_of(texts)
    settings = near_duplicates.JoinSettings(all_pairs=4)
    members, _ = near_duplicates.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), settings)
    assert {r["id"]: r["class_id"] for r in members.collect()} == want


@pytest.mark.parametrize("block_texts", [256, 30])
def test_crowded_buckets_lose_no_link(spark, block_texts):
    """300 near copies of one text: far over the limit for all pairs, all in one class."""
    draw = random.Random(8)
    base = prose(150, 300).split()
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(draw.randint(1, 4)):
            words[draw.randrange(len(words))] = f"new{draw.randint(0, 999)}"
        texts[i] = " ".join(words)
    texts |= {300 + i: prose(60, 400 + i) for i in range(20)} | {320: texts[3], 321: texts[3]}
    want, links = classes_of(texts)
    settings = near_duplicates.JoinSettings(block_texts=block_texts)
    members, pairs = near_duplicates.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), settings)
    got = {r["id"]: r for r in members.collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in texts}
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    first = {t: i for i, t in reversed(texts.items())}
    different = {first[t]: t for t in texts.values()}
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    assert 2 * len(found) == sum(classes_of(different)[1].values())


def test_awkward_rows(spark, documents, no_documents, awkward):
    members, links = near_duplicates.near_duplicate_classes(documents)
    rows = members.collect()
    assert len(rows) == documents.count() and links.count() == 0
    by_id = {r["id"]: r for r in rows}
    assert by_id[11]["class_id"] == by_id[10]["class_id"] == 10 and by_id[10]["n_links"] == 1
    assert all(by_id[i]["class_id"] == i and by_id[i]["n_links"] == 0 for i in (0, 1, 2))
    assert by_id[None]["class_id"] is None
    kept = near_duplicates.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([None, *[i for i, *_ in awkward if i != 11]], key=str)
    assert near_duplicates.near_duplicate_classes(no_documents)[0].count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def water(words, weights, repeats):
    """Targets by filling up step by step."""
    total, full = sum(words), {}
    while True:
        rest = [i for i in range(len(words)) if i not in full]
        if not rest:
            break
        level = (total - sum(full.values())) / sum(weights[i] for i in rest)
        over = [i for i in rest if level * weights[i] >= repeats * words[i]]
        if not over:
            return [full.get(i, level * weights[i]) for i in range(len(words))]
        full |= {i: repeats * words[i] for i in over}
    return [full[i] for i in range(len(words))]


def test_targets(spark):
    words = [10, 1000, 50, 400, 3000, 20, 700]
    df = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(words)], "source string, words long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, mixing.MixSettings()).collect()}
    want = water(words, [(5, 2, 1)[i % 3] for i in range(7)], 3)
    assert np.allclose([got[f"s{i}"] for i in range(7)], want)


def test_mix(spark, no_documents):
    draw = random.Random(5)
    rows = [(i, prose(draw.randint(5, 60), i), "en", ["big", "small", None, "tiny"][min(draw.randint(0, 9), 3) % 4] if i % 3 else "big", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    again = {r["doc_id"]: r["draws"] for r in mixing.mix(df).collect()}
    assert again == {r["doc_id"]: r["draws"] for r in out}
    source = {r[0]: r[3] for r in rows}
    taken, target = collections.Counter(), {}
    for r in out:
        assert len(r["draws"]) <= 3 and r["size"] == len(rows[r["doc_id"]][1].split())
        taken[source[r["doc_id"]]] += r["size"] * len(r["draws"])
        target[source[r["doc_id"]]] = r["target"]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    assert abs(sum(target.values()) - sum(r["size"] for r in out)) < 1e-6
    for s, t in target.items():
        assert abs(taken[s] - t) <= 30
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == sum(len(r["draws"]) for r in out)
    sharded = mixing.shards(df)
    assert {r["shard"] for r in sharded.select("shard").distinct().collect()} <= set(range(16))
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_rows(no_documents).count() == 0


def test_mix_awkward_rows(spark, documents):
    out = mixing.mix(documents).collect()
    assert len(out) == documents.count()
    assert {r["doc_id"]: r["size"] for r in out}[0] == 0


def test_tree_deals_out_everything(spark):
    quotas = spark.createDataFrame([("a", 37), ("b", 500), (None, 3), ("z", 0)], "source string, draws long")
    rows = mixing.splitting_tree(quotas, 3, 17).collect()
    by = collections.defaultdict(list)
    sizes = collections.Counter()
    for r in rows:
        by[r["source"]].append((r["shard"], r["first"], r["count"]))
        sizes[r["shard"]] += r["count"]
    for source, n in (("a", 37), ("b", 500), (None, 3), ("z", 0)):
        at = 0
        for _, first, count in sorted(by[source]):
            assert first == at and count >= 0
            at += count
        assert at == n
    assert max(sizes.values()) - min(sizes.values()) <= 3


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.expr(mixing.hypergeometric("12L", "30L", "10L", mixing._uniform("id"))).alias("k"))
    k = np.array([r["k"] for r in df.collect()])
    assert abs(k.mean() - 4.0) < 0.1 and abs(k.var() - 10 * 0.4 * 0.6 * 20 / 29) < 0.15 and k.min() >= 0 and k.max() <= 10


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("split", [1024, 40])
def test_search(spark, split):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2500, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] + [1.0] * 15, 0), (9003, [1.0] * 3, 0), (9004, [None] + [1.0] * 15, 0), (9005, [float("inf")] * 16, 0)]
    settings = nearest.SearchSettings(leaf_rows=400 if split < 100 else 24, split_rows=split, block_vectors=600, block_queries=50)
    got = nearest.search(spark.createDataFrame(rows + bad, VECTORS), "id % 20 = 0", settings).collect()
    d = x.astype(float)
    hits = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 2500, 20))
    for q, found in by.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score = d @ d[q]
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        score[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(2500), -np.round(score, 12)))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(by)


def test_search_repeated_rows(spark):
    """Rows of one id count once; the best of them as a candidate, the smallest as a query."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 4)).tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)]
    one_leaf = nearest.SearchSettings(leaf_rows=1000)  # exact, whatever the rows
    plain = sorted(tuple(r) for r in nearest.search(spark.createDataFrame(rows, VECTORS), "id % 20 = 0", one_leaf).collect())
    doubled = sorted(tuple(r) for r in nearest.search(spark.createDataFrame(rows + rows[:25] + rows[7:8] * 30, VECTORS), "id % 20 = 0", one_leaf).collect())
    assert plain == doubled and len(plain) == 60
    twice = nearest.search(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (1, [3.0, 0.0], 0), (2, [1.0, 1.0], 0)], VECTORS), "id = 0").collect()
    assert [tuple(r) for r in twice] == [(0, 1, 1, 3.0), (0, 2, 2, 1.0)]


def test_search_large_components(spark):
    rows = [(0, [1e200, 1.0], 0), (1, [1e200, -1e200], 0), (2, [1.0, 1.0], 0), (3, [-1e200, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = nearest.search(df, "id = 2").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(0, 1e200 + 1.0), (1, 0.0), (3, -1e200 + 2.0)]
    assert [r["vec_id"] for r in nearest.search(df, "id = 0").collect()] == [1, 2, 3]


def test_search_few_rows(spark):
    one = nearest.search(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [2.0, 1.0], 0)], VECTORS), "id % 20 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in one] == [(0, 1, 1, 4.0), (0, 2, 2, 4.0)]
    assert nearest.search(spark.createDataFrame([], VECTORS), "id % 20 = 0").count() == 0


def test_pipeline(spark):
    """Every stage's rows against a plain version, on all documents of the smallest table."""
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from cellstrand.llm import language_id, personal_data

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mixing", "best_fit_packing"]
    step = lambda k, df: corpus_pipeline.STAGES[k][1](spark, df, "/root/testdata/sf0.001")
    again = lambda df: spark.createDataFrame([tuple(r) for r in df.collect()], df.schema)

    model = language_id.fit(docs.where(~language_id.held_out()))
    encoders = language_id.compressors(model)
    told = {i: language_id.classify(r["text"], model, encoders) for i, r in rows.items()}
    rows = {i: r for i, r in rows.items() if told[i][0] != "und" and told[i][1] >= language_id.MIN_MARGIN}
    now = again(step(0, docs))
    assert now.columns == columns and {r["doc_id"]: r.asDict() for r in now.collect()} == rows and len(rows) >= 190

    classes, _ = classes_of({i: r["text"] for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if classes[i] == i}
    now = again(step(1, now))
    assert now.columns == columns and {r["doc_id"]: r.asDict() for r in now.collect()} == rows and 150 < len(rows) < 190

    field = personal_data.trained_field()
    for r in rows.values():
        r["text"] = personal_data.masked(r["text"], personal_data.all_spans(r["text"], field)[1])
        r["n_chars"] = len(r["text"])
    now = again(step(2, now))
    assert now.columns == columns and {r["doc_id"]: r.asDict() for r in now.collect()} == rows
    assert now.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][a-z]'").count() == 0

    size = {i: len(r["text"].split()) for i, r in rows.items()}
    sources = sorted({r["source"] for r in rows.values()})
    words = [sum(size[i] for i, r in rows.items() if r["source"] == s) for s in sources]
    target = water(words, [(5, 2, 1)[k % 3] for k in range(len(sources))], 3)
    now = again(step(3, now))
    times = collections.Counter(r["doc_id"] for r in now.collect())
    assert now.columns == columns and max(times.values()) <= 3 and all(r.asDict() == rows[r["doc_id"]] for r in now.collect())
    for s, t in zip(sources, target, strict=True):
        own = {i for i, r in rows.items() if r["source"] == s}
        assert abs(sum(size[i] * times[i] for i in own) - t) <= max(size[i] for i in own)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = step(4, now).collect()
    want = collections.Counter()
    for i, n in times.items():
        ids = [*library.encode(rows[i]["text"], add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, np.array(ids[at : at + 2048], "<u4").tobytes()] += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in packed) == want
    places = collections.defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 2048
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.sum("length")).first()[0] == sum(r["length"] for r in packed)


@pytest.mark.parametrize("k", [1, 5])
def test_short_texts_are_one_shingle(k):
    assert len(near_duplicates.shingle_set(near_duplicates.words_of("a b c"), 5)) == 1
    assert len(near_duplicates.shingle_set([], k)) == 0
