import gzip
import random

import pytest
from pyspark.sql import functions as F

from cellstrand.operators import annotation as an
from cellstrand.operators import mapping
from cellstrand.sources import bam, fastq, sinks, text

GTF = """#comment
Y\te\tgene\t2784749\t2784853\t.\t+\t.\tgene_id "ENSG00000251841";
Y\te\texon\t2784749\t2784853\t.\t+\t.\tgene_id "ENSG00000251841"; transcript_id "T1";
Y\te\texon\t2786855\t2787699\t.\t-\t.\tgene_id "ENSG00000184895"; transcript_id "T2";
"""
GFF = """##gff-version 3
Y\te\tgene\t1\t90\t.\t+\t.\tID=gene:G1;Name=x
Y\te\tmRNA\t1\t90\t.\t+\t.\tID=transcript:T1;Parent=gene:G1
Y\te\texon\t1\t50\t.\t+\t.\tParent=transcript:T1
Y\te\texon\t70\t90\t.\t+\t.\tID=e2;Dbxref=GeneID:77,X:1
"""


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    got = an.validate_saf(text.import_annotation(spark, str(tmp_path / "a.gtf")))
    assert sorted(tuple(r) for r in got.collect()) == [("ENSG00000184895", "Y", 2786855, 2787699, "-"), ("ENSG00000251841", "Y", 2784749, 2784853, "+")]


def test_gff_ids_through_parents(spark, tmp_path):
    with gzip.open(tmp_path / "a.gff3.gz", "wt") as f:
        f.write(GFF)
    got = text.import_annotation(spark, str(tmp_path / "a.gff3.gz"))
    assert sorted((r["GeneID"], r["Start"]) for r in got.collect()) == [("77", 70), ("G1", 1)]


def test_saf_errors(spark):
    with pytest.raises(TypeError):
        an.validate_saf(1)
    saf = spark.createDataFrame([("g", "1", 1, 2, None)], "GeneID string, Chr string, Start int, End int, Strand string")
    with pytest.raises(ValueError, match="columns of SAF"):
        an.validate_saf(saf.select("Chr", "GeneID", "Start", "End", "Strand"))
    with pytest.raises(ValueError, match="must not contain any NA"):
        an.validate_saf(saf)
    with pytest.raises(ValueError):
        text.read_gff(spark, "x.txt")


def test_fastq_round_trip(spark, tmp_path):
    for name, seqs in (("r1", ["ACGT", "GGGG", "TTTT"]), ("r2", ["AAAA", "CCCC"]), ("bc", ["AC", "GT", "TT"])):
        with gzip.open(tmp_path / f"{name}.fq.gz", "wt") as f:
            f.write("".join(f"@{i} extra\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs)))
    fastq.register(spark)
    path = lambda n: str(tmp_path / f"{n}.fq.gz")
    one = spark.read.format("fastq").load(path("r1"))
    assert [(r["ordinal"], r["name"], r["seq"], r["qual"]) for r in one.orderBy("ordinal").collect()] == [(i, str(i), s, "@@@@") for i, s in enumerate(["ACGT", "GGGG", "TTTT"])]
    two = spark.read.format("fastq").option("r2", path("r2")).option("barcodes", path("bc")).load(path("r1"))
    assert [(r["seq1"], r["seq2"], r["barcodes"][0]["seq"]) for r in two.orderBy("ordinal").collect()] == [("ACGT", "AAAA", "AC"), ("GGGG", "CCCC", "GT")]
    sinks.write_fastq(one, str(tmp_path / "out"), compress=False)
    lines = sorted(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "@0\nACGT\n+\n@@@@" in "".join(lines)


def test_bam_round_trip(spark, tmp_path):
    rows = [("r1", 99, "chr1", 10, 60, "4M", "chr1", 50, 44, "ACGT", "IIII", {"CB": "AC", "NM": "3"}), ("r2", 4, None, -1, 0, "*", None, -1, 0, "ACN", "*", {})]
    path = str(tmp_path / "a.bam")
    bam.write_file(path, [("chr1", 1000)], rows)
    bam.register(spark)
    got = spark.read.format("bam").load(path).orderBy("qname").collect()
    assert [tuple(r) for r in got] == rows
    tagged = bam.one_file_per_cell(spark, [path], ["TTTT"]).first()
    assert tagged["cell_bc"] == "TTTT"
    with pytest.raises(ValueError):
        bam.one_file_per_cell(spark, [path], [])


def test_region_and_barcode_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t0\t10\nchr1\t5\t9\textra\n")
    assert [tuple(r) for r in text.read_regions(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 10), ("chr1", 6, 9)]
    (tmp_path / "v.csv").write_text("x, ACGT ,y\nGGGG\n")
    assert [r[0] for r in text.read_valid_barcodes(spark, str(tmp_path / "v.csv")).collect()] == ["ACGT", "GGGG"]
    (tmp_path / "b.csv").write_text("cell_id,barcode\nCELL1,ACGT\nx\nCELL2,GGTT")
    assert [(r["cell_id"], r["barcode"]) for r in text.read_barcodes(spark, str(tmp_path / "b.csv")).collect()] == [("CELL1", "ACGT"), ("CELL2", "GGTT")]
    (tmp_path / "f.fa").write_text(">a one\nACGT\nAC\n>b\nG\n")
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "f.fa")).select("name", "sequence").collect()] == [("a", "ACGTAC"), ("b", "G")]


def test_exon_mapping(spark):
    saf = spark.createDataFrame([("g1", "chr1", 100, 200, "+"), ("g1", "chr1", 300, 400, "+"), ("g2", "chr1", 150, 180, "-")], "GeneID string, Chr string, Start int, End int, Strand string")
    genes = an.gene_models(saf)
    reads = spark.createDataFrame(
        [("exon", 0, "chr1", 110, "20M"), ("intron", 0, "chr1", 220, "20M"), ("nothing", 0, "chr1", 900, "20M"), ("spliced", 0, "chr1", 180, "10M120N10M"), ("un", 4, None, -1, "*"), ("minus", 16, "chr1", 160, "10M")],
        "qname string, flag int, rname string, pos int, cigar string",
    )
    got = {r["qname"]: (r["map_status"], r["gene_id"]) for r in mapping.map_exons(reads, genes).collect()}
    assert got["exon"] == (-190, "g1")
    assert got["spliced"] == (-90, "g1")
    assert (got["intron"], got["nothing"], got["un"]) == ((2, None), (3, None), (4, None))
    assert got["minus"][1] == "g2"
    both = {r["qname"]: r["map_status"] for r in mapping.map_exons(reads, genes, stranded=False).collect()}
    assert both["minus"] == 1


def test_exon_votes_stay_in_bins(spark):
    """Votes are the same in bins of any width, and only reads on several bins are dealt out by read."""
    draw = random.Random(7)
    exons = [(f"g{i // 3}", "chr1", 90 * i, 90 * i + draw.randint(5, 110), "+-"[i // 3 % 2]) for i in range(60)]
    genes = an.gene_models(spark.createDataFrame(exons, "GeneID string, Chr string, Start int, End int, Strand string")).cache()
    cigars = ("30M", "20M60N30M", "10M400N15M300N12M", "5S12M2D9M", "*")
    rows = [(f"r{i}", draw.choice((0, 16, 4)), draw.choice(("chr1", "chr1", None)), draw.randint(-20, 5500), draw.choice(cigars)) for i in range(300)]
    reads = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, cigar string")
    voted = [sorted(map(tuple, mapping.vote_reads(reads, genes, bin_width=w).select("qname", F.coalesce("map_status", F.lit(9)), F.coalesce("gene_id", F.lit(""))).collect())) for w in (32, 256, 1 << 20)]
    assert len(voted[0]) == 300 and voted[0] == voted[1] == voted[2]
    assert {min(v[1], 0) or v[1] for v in voted[0]} >= {1, 2, 3, 9} and min(v[1] for v in voted[0]) < 0
    plan = mapping.map_exons(reads, genes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(qname") == 1


def test_text_statistics(spark):
    assert mapping.mapping_summary(spark.createDataFrame([(-5,), (3,)], "map_status int")).agg(F.sum("count")).first()[0] == 2


def test_bam_splits(spark, tmp_path):
    """Every record comes once, wherever the file is cut, also those longer than a block."""
    import random

    from cellstrand.sources import bam

    draw = random.Random(3)
    rows = []
    for i in range(900):
        n = draw.choice([0, 5, 60, 150]) if i % 211 else 70000
        seq = "".join(draw.choice("ACGT") for _ in range(n))
        rows.append((f"read{i}", 0, f"chr{i % 3 + 1}", i, 30, f"{n}M" if n else "*", None, -1, 0, seq, "I" * n, {"BC": "ACGT" * 3, "YE": str(i)}))
    path = str(tmp_path / "a.bam")
    bam.write_file(path, [("chr1", 10**6), ("chr2", 10**6), ("chr3", 10**6)], rows)
    bam.register(spark)
    for split in (1 << 30, 20_000, 3_000):
        got = spark.read.format("bam").option("splitBytes", split).load(path)
        assert sorted((r["qname"], r["pos"], len(r["seq"]) if r["seq"] != "*" else 0, r["tags"]["YE"]) for r in got.collect()) == sorted((r[0], r[3], len(r[9]), str(r[3])) for r in rows)
    one = spark.read.format("bam").option("contig", "chr2").option("splitBytes", 20_000).load(path)
    assert {r["qname"] for r in one.collect()} == {r[0] for r in rows if r[2] == "chr2"}
    assert spark.read.format("bam").option("contig", "chr9").load(path).count() == 0


def test_files_of_single_cells(spark, tmp_path):
    """A cell's rows may be in several files; each file is of one cell, and odd texts come back."""
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>, cell string"
    rows = [(f"r{i}", 0, "chr1", i, 9, "*" if i % 5 == 0 else f"{1 + i % 7}M2N3=", None, -1, 0, "ACGTNRYW"[: i % 9], "*" if i % 9 == 0 else "I#!5?~JK"[: i % 9], {"BC": "AC", "YE": str(i)}, f"c{i % 3}") for i in range(300)]
    made = bam.write_cells(spark.createDataFrame(rows, schema).repartition(7), [("chr1", 1000)], str(tmp_path / "cells"), "cell")
    assert {c for c, _ in made} == {"c0", "c1", "c2"} and len({p for _, p in made}) == len(made)
    back = bam.one_file_per_cell(spark, [p for _, p in made], [c for c, _ in made])
    got = {r["qname"]: (r["pos"], r["cigar"], r["seq"], r["qual"], r["tags"], r["cell_bc"]) for r in back.collect()}
    assert got == {r[0]: (r[3], r[5], r[9], r[10], r[11], r[12]) for r in rows}
    for cell, path in made:
        assert {got[x[0]][5] for x in bam.alignments(path)} == {cell}
