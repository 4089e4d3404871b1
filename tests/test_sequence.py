import pytest
from pyspark.sql import functions as F

from cellstrand.functions import sequence as sq


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_hamming_and_edits(spark):
    lit = F.lit
    assert one(spark, sq.hamming(lit("ATCGTAAC"), lit("ATGCTAAC"))) == 2
    assert one(spark, sq.hamming(lit("AT"), lit("ATG"))) is None
    assert one(spark, sq.hamming(lit(""), lit(""))) == 0
    assert one(spark, sq.edit_distance(lit("ATCG"), lit("ACG"))) == 1


def test_complements(spark):
    assert one(spark, sq.reverse_complement(F.lit("ACGTX"))) == "NACGT"
    assert one(spark, sq.reverse_complement_iupac(F.lit("ACGTRYN"))) == "NRYACGT"


def test_interval_position(spark):
    at = lambda a, b: one(spark, sq.interval_position(*[F.lit(x) for x in (*a, *b)]))
    assert (at((1, 5), (2, 8)), at((2, 8), (6, 10)), at((1, 5), (6, 10)), at((6, 10), (1, 5))) == (0, 0, -1, 1)


@pytest.mark.parametrize("name", ["celSeq", "cel-Seq", "CelSeq"])
def test_read_structure(name):
    assert sq.read_structure(name) == sq.ReadStructure(-1, 0, 6, 8, 0, 6)


@pytest.mark.parametrize("name", ["FakeSeq", "errorseq"])
def test_unknown_protocol(name):
    with pytest.raises(ValueError, match="unknown protocol"):
        sq.read_structure(name)


def test_fix_chromosome(spark):
    rows = spark.createDataFrame([("1",), ("MT",), ("chrX",), ("GL000194",)], "c string")
    assert [r[0] for r in rows.select(sq.fix_chromosome("c")).collect()] == ["chr1", "chrM", "chrX", "GL000194"]


def test_fragment_key_round_trip(spark):
    row = spark.createDataFrame([("ATCGATCG", 0, 30, "AATTCCGG")], "c string, s int, e int, b string")
    made = row.select(sq.fragment_key("c", "s", "e", "b").alias("k")).select("k", sq.parse_fragment_key("k").alias("p")).first()
    assert made["k"] == "ATCGATCG|0|30|AATTCCGG"
    assert tuple(made["p"]) == ("ATCGATCG", 0, 30, "AATTCCGG")


def test_cigar(spark):
    row = spark.createDataFrame([(10, "5S20M100N30M2D3I4M")], "p int, c string")
    got = row.select(sq.aligned_segments("p", "c").alias("s"), sq.reference_length("c").alias("n")).first()
    assert [tuple(x) for x in got["s"]] == [(10, 30), (130, 160), (162, 166)]
    assert got["n"] == 156


def test_low_quality(spark):
    assert one(spark, sq.low_quality_count(F.lit("!5I"), 20)) == 2
    assert one(spark, sq.low_quality_count(F.lit("!5I"), 20, 0)) == 0
