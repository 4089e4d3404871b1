import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellstrand.operators import intervals as iv

SCHEMA = "chrom string, start int, end int, id int"


def brute(a, b, gap):
    return sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] + gap and y[1] - gap <= x[2])


spans = st.lists(st.tuples(st.sampled_from("xy"), st.integers(-300, 300), st.integers(0, 90)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=spans, b=spans, gap=st.sampled_from([0, 1, 7]))
def test_overlap_is_the_nested_loop(spark, a, b, gap):
    a, b = ([(c, s, s + n, i) for i, (c, s, n) in enumerate(x)] for x in (a, b))
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    pairs = brute(a, b, gap)
    got = iv.overlap_join(left, right, gap=gap, bin_width=64)
    assert sorted((r["id"], r["r_id"]) for r in got.collect()) == pairs
    hit = {i for i, _ in pairs}
    assert {r["id"] for r in iv.overlap_join(left, right, gap=gap, how="semi", bin_width=64).collect()} == hit
    assert {r["id"] for r in iv.overlap_join(left, right, gap=gap, how="anti", bin_width=64).collect()} == {x[3] for x in a} - hit


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=spans, b=spans, c=spans)
def test_flags_are_the_nested_loop(spark, a, b, c):
    """Every row, also those that are there twice or lie on several bins, has the flags of its own place."""
    rows = [(x, s, s + n, i) for i, (x, s, n) in enumerate(a)] * 2
    near, far = ([(x, s, s + n, i) for i, (x, s, n) in enumerate(y)] for y in (b, c))
    made = iv.overlap_flags(spark.createDataFrame(rows, SCHEMA), {"p": spark.createDataFrame(near, SCHEMA), "q": (spark.createDataFrame(far, SCHEMA), 7)}, bin_width=64)
    of = lambda x, ys, gap: any(x[0] == y[0] and x[1] <= y[2] + gap and y[1] - gap <= x[2] for y in ys)
    assert sorted(map(tuple, made.collect())) == sorted((*x, of(x, near, 0), of(x, far, 7)) for x in rows)


def test_flags_hash_the_regions(spark):
    """The bins' regions are hashed and rows pass by them: they are neither sorted nor held."""
    df = spark.createDataFrame([("x", 1, 2, 1)], SCHEMA)
    plan = iv.overlap_flags(df, {"p": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_join_kind(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        iv.overlap_join(df, df, how="full")


def test_no_nested_loop_in_the_plan(spark):
    df = spark.createDataFrame([("x", 1, 2, 1)], SCHEMA)
    plan = iv.overlap_join(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_flatten(spark):
    rows = spark.createDataFrame([("g", 6, 10), ("g", 2, 8), ("g", 1, 5), ("h", 1, 5), ("h", 6, 9)], "gene string, start int, end int")
    got = sorted(tuple(r) for r in iv.flatten(rows, ["gene"]).collect())
    assert got == [("g", 1, 10), ("h", 1, 5), ("h", 6, 9)]


def test_flatten_random(spark):
    draw = random.Random(4)
    rows = [(g, s, s + draw.randint(0, 30)) for g in "ab" for s in (draw.randint(0, 400) for _ in range(40))]
    want = []
    for g in "ab":
        for s, e in sorted(r[1:] for r in rows if r[0] == g):
            if want and want[-1][0] == g and s <= want[-1][2]:
                want[-1] = (g, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((g, s, e))
    got = iv.flatten(spark.createDataFrame(rows, "gene string, start int, end int"), ["gene"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_tiles(spark):
    sizes = spark.createDataFrame([("chr21", 1019940), ("even", 4000), ("none", 0)], "chrom string, length long")
    got = sorted(tuple(r) for r in iv.tiles(sizes, 2000).collect())
    assert len([x for x in got if x[0] == "chr21"]) == 510
    assert ("chr21", 1018001, 1019940) in got
    assert [x for x in got if x[0] == "even"] == [("even", 1, 2000), ("even", 2001, 4000)]


def test_tss_bins(spark):
    got = iv.tss_bins(spark.createDataFrame([("c", 5000)], "chrom string, start int"), ["chrom"]).orderBy("bin").collect()
    assert (len(got), got[0]["dists"], got[-1]["dists"]) == (39, -1900, 1900)
    assert (got[0]["start"], got[0]["end"], got[-1]["start"]) == (3050, 3149, 6850)
