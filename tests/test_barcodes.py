import random

import pandas as pd
import pytest

from cellstrand.operators import barcodes as bc


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99


def words(draw, n, letters="ACGT", length=6):
    return ["".join(draw.choice(letters) for _ in range(length)) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 2])
def test_nearest_unique_is_brute_force(spark, most):
    draw = random.Random(most)
    listed, seen = sorted(set(words(draw, 40))), sorted(set(words(draw, 300)))
    want = {}
    for s in seen:
        d = sorted((hamming(s, w), w) for w in listed)
        if d[0][0] <= most and (len(d) == 1 or d[1][0] != d[0][0]):
            want[s] = d[0][1]
    got = bc.nearest_unique(frame(spark, seen, "seen"), frame(spark, listed, "barcode"), most)
    assert {r["seen"]: r["barcode"] for r in got.collect()} == want


def test_nearest_unique_examples(spark):
    listed = ["ATGATCAT", "ATGATATA", "GGGGGGGG"]
    got = bc.nearest_unique(frame(spark, ["ATGATAAA", "AAAAAAAA", "GGGGGGGG"], "seen"), frame(spark, listed[:1] + listed[2:], "barcode"), 2)
    assert {r["seen"]: r["barcode"] for r in got.collect()} == {"ATGATAAA": "ATGATCAT", "GGGGGGGG": "GGGGGGGG"}


def tree_matches(listed, seen):
    """A walk down the prefix tree: a substitution only where the letter is missing; N is any letter."""

    def walk(prefix, rest, at, changed):
        if not rest:
            return {(prefix, -1 if changed is None else changed)} if prefix in listed else set()
        children = {w[len(prefix)] for w in listed if w.startswith(prefix) and len(w) > len(prefix)}
        c, tail = rest[0], rest[1:]
        if c == "N":
            return set().union(*[walk(prefix + x, tail, at + 1, changed) for x in children]) if children else set()
        if c in children:
            return walk(prefix + c, tail, at + 1, changed)
        if changed is not None:
            return set()
        return set().union(*[walk(prefix + x, tail, at + 1, at) for x in children]) if children else set()

    return walk("", seen, 0, None)


def test_prefix_match_is_the_tree_walk(spark):
    draw = random.Random(8)
    listed = set(words(draw, 25, length=4))
    seen = sorted(set(words(draw, 150, length=4)))
    got = {}
    for r in bc.prefix_match(frame(spark, seen, "seen"), frame(spark, sorted(listed), "barcode")).collect():
        got.setdefault(r["seen"], set()).add((r["barcode"], r["position"]))
    assert got == {s: m for s in seen if (m := tree_matches(listed, s))}


def test_prefix_match_with_n(spark):
    got = bc.prefix_match(frame(spark, ["AGNC", "NNNN"], "seen"), frame(spark, ["AGTC", "AGGC"], "barcode")).collect()
    assert sorted((r["seen"], r["barcode"], r["position"]) for r in got) == [("AGNC", "AGGC", -1), ("AGNC", "AGTC", -1), ("NNNN", "AGGC", -1), ("NNNN", "AGTC", -1)]


def test_prefix_match_one_of_three(spark):
    got = bc.prefix_match(frame(spark, ["ATCC"], "seen"), frame(spark, ["ATTC", "AGGT", "AGCC"], "barcode")).collect()
    assert [(r["barcode"], r["position"]) for r in got] == [("ATTC", 2)]


def test_prefix_match_by_quality(spark):
    reads = spark.createDataFrame([("AAAA", "IIII"), ("AATT", "II!I")], "seen string, q string")
    got = bc.prefix_match(reads, frame(spark, ["AACA", "AAGA", "AAGT"], "barcode"), quality="q").collect()
    assert [(r["seen"], r["barcode"]) for r in got] == [("AAAA", "AACA")]


def test_whitelist_merge(spark):
    counts = spark.createDataFrame([("AAAA", 5), ("AAAT", 2), ("GGGG", 4)], "barcode string, n long")
    got = bc.merge_into_whitelist(counts, frame(spark, ["AAAA", "CCCC"], "barcode"), 1)
    assert [tuple(r) for r in got.collect()] == [("AAAA", 7)]


def test_greedy_merge():
    out = bc._merge_greedily(pd.DataFrame({"barcode": ["AAAA", "AAAT", "GGGG"], "n": [50, 10, 20]}), 1)
    assert dict(zip(out["barcode"], out["n"], strict=True)) == {"AAAA": 60, "GGGG": 20}


def test_histogram_limits(spark):
    df = spark.createDataFrame([("ACGTACGT_x", 0)], "name string, ordinal long")
    with pytest.raises(ValueError):
        bc.histogram(df, 3)
    with pytest.raises(ValueError):
        bc.histogram(df, 8, max_reads=10)
    assert [tuple(r) for r in bc.histogram(df, 8).collect()] == [("ACGTACGT", 1)]


def test_ranked_cells(spark):
    counts = spark.createDataFrame([("A", 5), ("B", 5), ("C", 9)], "barcode string, n long")
    got = sorted(tuple(r) for r in bc.ranked_cells(counts, 2).collect())
    assert got == [("CELL_01", "C", 9), ("CELL_02", "B", 5)]


def test_start_position(spark):
    reads = spark.createDataFrame([(i, ("GTCT" if i % 2 else "CGTC") + "AAAA") for i in range(40)], "ordinal long, seq string")
    listed = frame(spark, ["GTCT", "CGTC"], "barcode")
    assert bc.start_position(reads, listed, 0, 4, threshold=0.5)["ok"]
    bad = bc.start_position(reads, listed, 2, 4, threshold=0.5)
    assert not bad["ok"] and (bad["best"], bad["best_fraction"]) == (0, 1.0)


def test_reverse_decision(spark):
    reads = spark.createDataFrame([(i, "AAAA") for i in range(5)], "ordinal long, seq string")
    row = bc.needs_reverse_complement(reads, frame(spark, ["CCCC"], "barcode"), 0, 4, misses=4).first()
    assert (row["missed"], row["reverse"]) == (5, True)


def test_merge_by_components_is_the_greedy_merge(spark):
    import random

    import pandas as pd

    draw = random.Random(5)
    counts = {}
    for _ in range(40):
        base = "".join(draw.choice("ACGT") for _ in range(7))
        counts[base] = draw.randint(5, 60)
        for _ in range(draw.randint(0, 4)):
            k = draw.randrange(7)
            counts[base[:k] + draw.choice("ACGTN") + base[k + 1 :]] = draw.randint(1, 12)
    rows = list(counts.items())
    want = {r.barcode: r.n for r in bc._merge_greedily(pd.DataFrame(rows, columns=["barcode", "n"]), 1).itertuples()}
    got = bc.merge_neighbours(spark.createDataFrame(rows, "barcode string, n long"), 1, 1)
    assert {r["barcode"]: r["n"] for r in got.collect()} == want
