import random

from hypothesis import given
from hypothesis import strategies as st

from cellstrand.operators import fragments as fr
from cellstrand.operators import umi

V1 = ["ATGCTAAC@100", "GTAGTAGC@100", "ATGCTAAC@110", "ATCTGCCC@150"]
V2 = ["ATGCTAAC@100", "ATGCTAAT@100", "ATGCTAAC@110", "ATCTGCCC@150"]


def rows(cell, genes):
    return [(cell, g, v.split("@")[0], int(v.split("@")[1])) for g, vs in genes.items() for v in vs]


def reads(spark, data):
    return spark.createDataFrame(data, "cell_id string, gene_id string, UMI string, position int")


def test_first_correction(spark):
    data = rows("c", {"GENE01": V1, "GENE02": V1, "GENE03": V2})
    made = umi.count_genes(reads(spark, data), spark.createDataFrame([("c",)], "cell_id string"), mode=1, gene_filter=True)
    assert {r["gene_id"]: r["n"] for r in made["counts"].collect()} == {"GENE01": 3, "GENE02": 3, "GENE03": 2}
    hist = {r["duplication_number"]: r["count"] for r in made["duplication"].collect()}
    assert len(hist) == 1001 and hist[3] == 1
    stat = made["statistics"].first()
    assert (stat["corrected_UMI"], stat["filtered_gene"]) == (4, 0)


def test_second_correction_as_it_was(spark):
    data = rows("c", {"GENE01": V1, "GENE03": V2})
    made = umi.count_genes(reads(spark, data), spark.createDataFrame([("c",)], "cell_id string"), mode=2, compat=True)
    assert {r["gene_id"]: r["n"] for r in made["counts"].collect()} == {"GENE01": 0, "GENE03": 0}
    fixed = umi.count_genes(reads(spark, data), spark.createDataFrame([("c",)], "cell_id string"), mode=2)
    assert {r["gene_id"]: r["n"] for r in fixed["counts"].collect()} == {"GENE01": 4, "GENE03": 3}


def test_no_correction_and_low_genes(spark):
    data = rows("c", {"A": ["AAA@1"], "B": ["AAA@1", "AAA@2"]})
    made = umi.count_genes(reads(spark, data), spark.createDataFrame([("c",), ("d",)], "cell_id string"), mode=0, gene_filter=True)
    assert {r["gene_id"]: r["n"] for r in made["counts"].collect()} == {"B": 2}
    assert {r["cell_id"]: r["filtered_gene"] for r in made["statistics"].collect()} == {"c": 1, "d": 0}


pairs = st.dictionaries(st.tuples(st.text("AC", min_size=3, max_size=3), st.integers(1, 3)), st.integers(1, 6), max_size=8)


@given(pairs)
def test_corrections_keep_reads(p):
    for fix in (umi.correct_mode_1, umi.correct_mode_2, umi.correct_mode_3):
        left, n = fix(p)
        assert sum(left.values()) == sum(p.values())
        assert len(left) + n == len(p)


def test_streamed_groups_equal_plain_ones(spark):
    draw = random.Random(2)
    data = [(f"c{draw.randint(0, 3)}", f"g{draw.randint(0, 5)}", "".join(draw.choice("AC") for _ in range(3)), draw.randint(1, 3)) for _ in range(600)]
    counted: dict = {}
    for c, g, u, p in data:
        counted.setdefault((c, g), {}).setdefault((u, p), 0)
        counted[c, g][u, p] += 1
    got = umi.gene_counts(umi.corrected_pairs(umi.pair_counts(reads(spark, data)), 1)).collect()
    assert {(r["cell_id"], r["gene_id"]): r["n"] for r in got} == {k: len(umi.correct_mode_1(v)[0]) for k, v in counted.items()}


ENDS = "ord long, rname string, qname string, coordinate int, reverse boolean, barcode string"


def test_pairing_is_the_fold(spark):
    draw = random.Random(5)
    data = [(i, "chr1", f"q{draw.randint(0, 120)}", draw.randint(0, 300), draw.random() < 0.5, draw.choice([None, "AC", "GT"])) for i in range(300)]
    groups: dict = {}
    for o, _, q, c, r, b in data:
        groups.setdefault(q, []).append((c, r, b))
    want = sorted(("chr1", *f) for g in groups.values() if (f := fr.fold_pairs(g, 10, 5000)))
    got = fr.paired(spark.createDataFrame(data, ENDS))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_forward_then_reverse():
    assert fr.fold_pairs([(10, False, "CC"), (60, True, None)], 10, 5000) == (10, 60, "CC")
    assert fr.fold_pairs([(10, False, None), (60, True, None)], 10, 5000) is None
    assert fr.fold_pairs([(10, False, "CC"), (20, False, "CC")], 10, 5000) is None


def test_collapse(spark):
    six = [("AATG", 3, e, "GG") for e in (25, 60, 50)] + [("AAGG", 4, e, "GT") for e in (15, 25)] + [("AGTC", 5, 30, "GA")]
    got = fr.collapsed(spark.createDataFrame(six, "chrom string, start int, end int, barcode string"))
    assert sorted((r["chrom"], r["start"], r["end"], r["count"]) for r in got.collect()) == [("AAGG", 4, 15, 2), ("AATG", 3, 25, 3), ("AGTC", 5, 30, 1)]


def test_ties_go_by_text(spark):
    two = [("c", 1, 99, "A"), ("c", 1, 100, "A")]
    got = fr.collapsed(spark.createDataFrame(two, "chrom string, start int, end int, barcode string")).first()
    assert (got["end"], got["count"]) == (100, 2)


def test_eligible_ends(spark):
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, cell_bc string"
    rows_ = [("a", 0, "chr1", 100, 60, "50M", "AC"), ("a", 16, "chr1", 200, 60, "50M", "AC"), ("b", 0, "chr1", 1, 10, "50M", "AC"), ("c", 0, "other", 1, 60, "50M", "AC")]
    got = fr.create_fragments(spark.createDataFrame(rows_, schema)).collect()
    assert [tuple(r) for r in got] == [("chr1", 104, 245, "AC", 1)]


def test_large_groups_are_corrected_like_small_ones():
    """Candidates by keys give what looking at all pairs gives."""
    draw = random.Random(9)
    pairs = {}
    for _ in range(260):
        u = "".join(draw.choice("ACGT") for _ in range(draw.choice([5, 5, 5, 4])))
        pairs[u, draw.randint(0, 3)] = draw.randint(1, 6)
    every = umi._candidates
    for fix in (umi.correct_mode_1, umi.correct_mode_2, umi.correct_mode_3):
        found = fix(pairs)
        umi._candidates = lambda order, most: lambda u: order
        try:
            assert found == fix(pairs)
        finally:
            umi._candidates = every
