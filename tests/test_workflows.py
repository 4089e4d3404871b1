from cellstrand.functions.sequence import FilterSettings, ReadStructure
from cellstrand.operators import demux, features, matrix, reads, workflows

PAIR = "ordinal long, name string, seq1 string, qual1 string, seq2 string, qual2 string, barcodes array<struct<seq:string,qual:string>>"


def test_trim_layouts(spark):
    pair = spark.createDataFrame([(0, "r", "AACCCC", "IIIIII", "GGGGGGTTTTTTTTAA", "I" * 16, [])], PAIR)
    both = reads.trim_paired(pair, ReadStructure(0, 2, 6, 8, 0, 6)).first()
    assert (both["name"], both["seq"], both["qual"], both["status"]) == ("AATTTTTTTT_GGGGGG#r", "CCCC", "IIII", "pass")
    one = reads.trim_paired(pair, ReadStructure(-1, 0, 6, 8, -1, 0)).first()
    assert (one["name"], one["seq"]) == ("TTTTTTTT_#r", "AACCCC")


def test_trim_filters(spark):
    rows = [(0, "ok", "AA", "II", "GGGG", "IIII", []), (1, "n", "AA", "II", "GNGG", "IIII", []), (2, "low", "AA", "II", "GNGG", "!!!!", []), (3, "short", "AA", "II", "G", "I", [])]
    made = reads.trim_paired(spark.createDataFrame(rows, PAIR), ReadStructure(-1, 0, 0, 4, -1, 0), FilterSettings())
    assert {r["ordinal"]: r["status"] for r in made.collect()} == {0: "pass", 1: "has_n", 2: "low_quality"}
    assert tuple(reads.trim_summary(made).first()) == (1, 1, 1)
    raw = reads.trim_paired(spark.createDataFrame(rows, PAIR), ReadStructure(-1, 0, 0, 4, -1, 0), FilterSettings(rmN=False), raw_quality=True)
    assert {r["status"] for r in raw.collect()} == {"pass"}


def test_barcode_reads(spark):
    code = lambda s: [(s, "I" * len(s))]
    rows = [(i, f"r{i}", "AA", "II", "CC", "II", code(s)) for i, s in enumerate(["ACGT", "ACGA", "TTTT", "ACNT"])]
    valid = spark.createDataFrame([("ACGT",), ("GGGG",)], "barcode string")
    made, summary = workflows.atac_trim(spark.createDataFrame(rows, PAIR), valid, length=4, reverse_complement=False)
    got = {r["ordinal"]: (r["name"], r["match_type"], r["status"]) for r in made.collect()}
    assert got[0] == ("ACGT#r0", "exact", "pass")
    assert got[1] == ("ACGT#r1", "partial", "pass")
    assert got[2] == ("TTTT#r2", "none", "pass")
    assert got[3][2] == "has_n"
    s = summary.first()
    assert (s["total"], s["removed_has_n"], s["exact_match"], s["partial_match"], s["none_match"]) == (4, 1, 1, 1, 1)


def test_turned_list(spark):
    rows = [(i, "r", "AAAACC", "IIIIII", "AAAACC", "IIIIII", []) for i in range(5)]
    valid = spark.createDataFrame([("TTTT",)], "barcode string")
    made, _ = workflows.atac_trim(spark.createDataFrame(rows, PAIR), valid, barcode_reads=False, length=4, reverse_complement=True)
    assert {(r["name1"], r["seq1"], r["match_type"]) for r in made.collect()} == {("AAAA#r", "CC", "exact")}


def test_rna_run(spark):
    saf = spark.createDataFrame([("g1", "chr1", 100, 400, "+"), ("g2", "chr1", 1000, 1400, "+")], "GeneID string, Chr string, Start int, End int, Strand string")
    reads_ = [(f"{bc}_{umi}#r{i}", 0, "chr1", pos, "20M") for i, (bc, umi, pos) in enumerate([("AAAA", "AC", 110), ("AAAA", "AC", 110), ("AAAT", "GT", 200), ("GGGG", "AC", 1100), ("CCTT", "AC", 1100), ("GGGG", "CC", 2000)])]
    alignments = spark.createDataFrame(reads_, "qname string, flag int, rname string, pos int, cigar string")
    cells = spark.createDataFrame([("one", "AAAA", 1), ("two", "GGGG", 2)], "cell_id string, barcode string, ord int")
    e = workflows.count_aligned(alignments, saf, cells, barcode_length=4, umi_length=2)
    assert {(r["feature"], r["cell"]): r["n"] for r in e.counts.collect()} == {("g1", "one"): 2, ("g2", "two"): 1}
    status = {r["status"]: r["count"] for r in e.demultiplex_info.collect()}
    assert (status["barcode_match"], status["barcode_unmatch_mapped_to_exon"], len(status)) == (5, 1, 6)
    report = workflows.rna_report(e)
    assert report["metrics"].count() == 2 and report["mapping"].count() > 0


def test_knee(spark):
    totals = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate([10000] * 5 + [9000] * 5 + [8000] * 5 + [20] * 50 + [10] * 200)], "bc string, total int")
    row = features.knee_points(features.size_ranks(totals), lower=1).first()
    assert row["inflection"] == 8000 and row["knee"] >= 8000


def test_cells_that_share_a_barcode(spark):
    cells = spark.createDataFrame([("A", "AAAA", 0), ("B", "AAAA", 1), ("C", "CCCC", 2), ("D", "GGGG", 3)], "cell_id string, barcode string, ord long")
    reads_ = spark.createDataFrame([(b,) for b in ("AAAA", "AAAT", "CCCC", "CCCT", "GGGG", None)], "cell_bc string")
    made = demux.assign_cells(reads_, cells, 1)
    assert {r["cell_bc"]: (r["cell_id"], r["matched_bc"]) for r in made.collect()} == {
        "AAAA": (None, None), "AAAT": (None, None), "CCCC": ("C", "CCCC"), "CCCT": ("C", "CCCC"), "GGGG": ("D", "GGGG"), None: (None, None)
    }


def test_atac_run_keeps_the_order_of_equal_fragments(spark):
    """Of fragments as frequent the first by key text takes the sum, which places that were moved would change."""
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, pnext int, cell_bc string, ordinal long"
    ends = [("a", 0, 1096, "AC"), ("a", 16, 1500, "AC"), ("b", 0, 86, "AC"), ("b", 16, 1500, "AC"), ("c", 0, -4, "AC"), ("c", 16, 99, "AC")]
    rows = [(q, flag, "chr1", pos, 60, "1M", 0, b, i) for i, (q, flag, pos, b) in enumerate(ends)]
    region = spark.createDataFrame([("chr1", 0, 95), ("chr1", 980, 995)], "chrom string, start int, end int")
    _, tables = workflows.atac_run(spark.createDataFrame(rows, schema), region, region, region, region, first=-4)
    kept = {(r["start"], r["end"]): r["count"] for r in tables["fragments"].collect()}
    assert kept == {(1100, 1496): 2, (0, 95): 1}


def test_counts_are_made_once(spark):
    """Filters look at a matrix that is written, so what made it does not run again for each look."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "feature string, barcode string, n long"
    counts = spark.createDataFrame([(f"f{i % 12}", f"b{i // 12}", 30) for i in range(144)], schema).mapInArrow(look, schema)
    assert features.filter_counts(counts, 20, 10).count() == 144
    assert seen.value == 144


def test_scaling_makes_counts_once(spark):
    """Sums of cells and features are held against counts that are written, and not made again."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "feature string, barcode string, n long"
    counts = spark.createDataFrame([(f"f{i % 12}", f"b{i // 12}", 1 + i % 5) for i in range(144)], schema).mapInArrow(look, schema)
    assert matrix.tf_idf(counts).count() == 144
    assert matrix.lsi(matrix.tf_idf(counts), rank=4, rounds=2).count() == 12
    assert seen.value == 2 * 144
