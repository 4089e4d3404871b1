"""Round trips: tables written by a sink and read again by a source; the SQL is the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import annotation, demux, experiment, features, fragments, umi
from ..sources import bam, fastq, sinks, text
from ..sources.storage import files_of, new_place
from .assay import frame, sql
from .catalog import query, rounded
from .registry import _COL, _COUNTS, _INLINE, _QC, _QC_TABLES, _UC, _assigned, _counts, _hist, _inline, _qc, _umi_matrix
from .registry import _ASSIGNED, _HIST, _FRACTIONS
from .steps import table


def _write_fastq(spark, rows, name, seq, qual):
    place = new_place(spark, "reads")
    sinks.write_fastq(rows, place, name, seq, qual)
    return files_of(spark.read.text(place))


def _lines(rows, column, place):
    sinks.write_lines(rows, column, place)
    return place


# --- reads and alignments -----------------------------------------------------------------


@query(sql("v_pairs") + " SELECT name, seq1 AS seq, qual1 AS qual FROM v_pairs")
def fastq_reads(spark, d):
    return fastq.read_reads(spark, _write_fastq(spark, frame(spark, d, "v_pairs"), "name", "seq1", "qual1")).select("name", "seq", "qual")


@query(sql("v_pairs") + " SELECT name, seq1, qual1, seq2, qual2 FROM v_pairs")
def fastq_pairs(spark, d):
    rows = frame(spark, d, "v_pairs")
    mates = [_write_fastq(spark, rows, "name", f"seq{m}", f"qual{m}") for m in (1, 2)]
    return fastq.read_reads(spark, *mates).select("name", "seq1", "qual1", "seq2", "qual2")


@query(sql("v_pairs") + " SELECT name, seq1, seq2, substr(seq2, 1, 6) AS first, substr(seq1, 1, 4) AS second FROM v_pairs")
def fastq_with_barcode_reads(spark, d):
    rows = frame(spark, d, "v_pairs").withColumns({"b1": F.substring("seq2", 1, 6), "q1": F.substring("qual2", 1, 6), "b2": F.substring("seq1", 1, 4), "q2": F.substring("qual1", 1, 4)})
    one, two, first, second = (_write_fastq(spark, rows, "name", s, q) for s, q in (("seq1", "qual1"), ("seq2", "qual2"), ("b1", "q1"), ("b2", "q2")))
    read = fastq.read_reads(spark, one, two, [list(group) for group in zip(first, second, strict=True)])
    return read.select("name", "seq1", "seq2", F.col("barcodes")[0]["seq"].alias("first"), F.col("barcodes")[1]["seq"].alias("second"))


@query(sql("v_pairs", "v_cells") + _INLINE + " SELECT CAST(mate AS INT) AS mate, match_type, count(*) AS reads FROM t, (VALUES (1), (2)) m(mate) WHERE status = 'pass' GROUP BY 1, 2")
def reads_by_match_type(spark, d):
    place = new_place(spark, "trimmed")
    sinks.write_by_match_type(_inline(spark, d), place)
    lines = spark.read.text(place)
    return lines.where("value like '@%#read%'").groupBy(F.col("mate").cast("int").alias("mate"), "match_type").agg(F.count("*").alias("reads"))


@query(sql("v_pairs", "v_cells") + _INLINE + " SELECT name1, seq2 FROM t WHERE status = 'pass' AND match_type <> 'none'")
def complete_and_partial(spark, d):
    return demux.matched_reads(_inline(spark, d)).select("name1", "seq2")


_CHROMS = [(f"chr{k}", 10_000_000) for k in range(1, 8)]


def _alignments(spark, d):
    none = lambda kind: F.lit(None).cast(kind)
    rows = frame(spark, d, "v_aligned").distinct()
    return rows.select(
        "qname", F.col("flag").cast("int").alias("flag"), "rname", "pos", F.lit(40).alias("mapq"), "cigar", none("string").alias("rnext"), F.lit(-1).alias("pnext"), F.lit(0).alias("tlen"),
        F.lit("ACGTN").alias("seq"), F.lit("IIII#").alias("qual"), F.create_map(F.lit("BC"), F.substring("qname", 1, 3), F.lit("YE"), F.col("flag").cast("string")).alias("tags"),
    )


def _read_bam(spark, files):
    bam.register(spark)
    return spark.read.format("bam").load(",".join(files))


_ALIGNED = "SELECT DISTINCT qname, CAST(flag AS INT) AS flag, rname, pos, cigar FROM v_aligned"


@query(sql("v_aligned") + f" SELECT qname, flag, rname, pos, cigar, 'ACGTN' AS seq, 'IIII#' AS qual, substr(qname, 1, 3) AS cell_bc, CAST(flag AS INT) AS map_status FROM ({_ALIGNED})")
def bam_alignments(spark, d):
    read = bam.with_tag_columns(_read_bam(spark, bam.write_parts(_alignments(spark, d), _CHROMS, new_place(spark, "bam"))))
    return read.select("qname", "flag", "rname", "pos", "cigar", "seq", "qual", "cell_bc", "map_status")


@query(sql("v_aligned") + f" SELECT qname, pos FROM ({_ALIGNED}) WHERE rname = 'chr3' AND pos < 60000")
def bam_region(spark, d):
    files = bam.write_parts(_alignments(spark, d), _CHROMS, new_place(spark, "bam"))
    bam.register(spark)
    return spark.read.format("bam").option("contig", "chr3").load(",".join(files)).where("pos < 60000").select("qname", "pos")


@query(sql("v_aligned") + f" SELECT rname AS cell_bc, count(*) AS n, min(pos) AS first FROM ({_ALIGNED}) GROUP BY 1")
def bam_per_cell(spark, d):
    made = bam.write_cells(_alignments(spark, d), _CHROMS, new_place(spark, "cells"), "rname")
    return bam.one_file_per_cell(spark, [path for _, path in made], [name for name, _ in made]).groupBy("cell_bc").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(sql("v_aligned") + " SELECT rname, 2 * count(*) AS n, min(pos) AS first, max(pos) AS last FROM v_aligned GROUP BY 1")
def alignments_appended(spark, d):
    place = new_place(spark, "alignments")
    rows = frame(spark, d, "v_aligned")
    sinks.write_alignments(rows, place, by_contig=True)
    sinks.write_alignments(rows, place, mode="append")
    return spark.read.parquet(place).groupBy("rname").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


# --- annotation ---------------------------------------------------------------------------

_SAF = "SELECT gene_id AS \"GeneID\", {} AS \"Chr\", CAST(start AS INT) AS \"Start\", CAST(stop AS INT) AS \"End\", CASE WHEN strand = 1 THEN '+' ELSE '-' END AS \"Strand\" FROM v_exon"


def _saf(spark, d, chrom="chrom"):
    sign = F.when(F.col("strand") == 1, "+").otherwise("-")
    return frame(spark, d, "v_exon").select(F.col("gene_id").alias("GeneID"), F.expr(chrom).alias("Chr"), F.col("start").alias("Start"), F.col("end").alias("End"), sign.alias("Strand"))


def _feature_lines(spark, d, kind, attributes):
    return _saf(spark, d).select(F.concat_ws("\t", "Chr", F.lit("made"), F.lit(kind), "Start", "End", F.lit("."), "Strand", F.lit("."), F.expr(attributes)).alias("line"))


def _gff3(spark, d):
    genes = _feature_lines(spark, d, "gene", "concat('ID=gene:', GeneID, ';Name=', GeneID)").distinct()
    transcripts = _feature_lines(spark, d, "mRNA", "concat('ID=transcript:T', GeneID, ';Parent=gene:', GeneID)").distinct()
    exons = _feature_lines(spark, d, "exon", "concat('Parent=transcript:T', GeneID, ';rank=1')")
    head = spark.createDataFrame([("##gff-version 3",)], "line string")
    return _lines(head.unionByName(genes).unionByName(transcripts).unionByName(exons), "line", new_place(spark, "a.gff3"))


def _gtf(spark, d):
    return _lines(_feature_lines(spark, d, "exon", """concat('gene_id "', GeneID, '"; transcript_id "T', GeneID, '"; note "a; b";')"""), "line", new_place(spark, "a.gtf"))


@query(sql("v_exon") + " " + _SAF.format("chrom"))
def gff3_exons(spark, d):
    return text.import_annotation(spark, _gff3(spark, d))


@query(sql("v_exon") + " " + _SAF.format("chrom"))
def gtf_exons(spark, d):
    return text.ercc_annotation(spark, _gtf(spark, d))


@query(sql("v_exon") + " SELECT gene_id, concat('T', gene_id) AS transcript_id, 'a; b' AS note FROM v_exon")
def gtf_attributes(spark, d):
    a = F.col("attr")
    return text.read_gff(spark, _gtf(spark, d)).select(a["gene_id"].alias("gene_id"), a["transcript_id"].alias("transcript_id"), a["note"].alias("note"))


@query(sql("v_exon") + " SELECT gene_id AS \"GeneID\", 2 * count(*) AS n FROM v_exon GROUP BY 1")
def annotations_bound(spark, d):
    return text.import_annotation(spark, [_gff3(spark, d), _gtf(spark, d)]).groupBy("GeneID").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('a', 'ensembl'), ('b', 'gencode'), ('c', 'refseq')) t(name, source)")
def annotation_sources(spark, d):
    heads = {"a": "##gff-version 3", "b": "##provider: GENCODE", "c": "chr1\tRefSeq\tgene\t1\t2\t.\t+\t.\tDbxref=GeneID:1"}
    made = [(n, text.annotation_source(spark, _lines(spark.createDataFrame([(h,)], "line string"), "line", new_place(spark, f"{n}.gff3")))) for n, h in heads.items()]
    return spark.createDataFrame(made, "name string, source string")


@query(sql("v_exon") + " " + _SAF.format("chrom"))
def saf_table(spark, d):
    place = new_place(spark, "saf")
    _saf(spark, d).write.csv(place, sep="\t", header=True)
    return annotation.validate_saf(text.read_saf(spark, place))


@query(sql("v_exon") + " " + _SAF.format("chrom"))
def exon_bed_table(spark, d):
    place = new_place(spark, "exons")
    _saf(spark, d).toDF("id", "chromosome", "first", "last", "strand").write.csv(place, sep="\t", header=True)
    return text.read_exon_bed(spark, place)


@query(sql("v_exon") + " SELECT chrom, gene_id, CAST(min(start) AS INT) AS start, CAST(max(stop) AS INT) AS stop, CAST(min(strand) AS INT) AS strand FROM v_exon GROUP BY 1, 2")
def gene_models_fixed_names(spark, d):
    models = annotation.gene_models(_saf(spark, d, "substr(chrom, 4, 9)"), fix_chr=True)
    return models.select("chrom", "gene_id", "start", F.col("end").alias("stop"), "strand")


# --- regions, sequences, lists ------------------------------------------------------------


@query(sql("v_promoter") + " SELECT chrom, CAST(start + 1 AS INT) AS start, CAST(stop AS INT) AS stop FROM v_promoter")
def bed_regions(spark, d):
    place = new_place(spark, "a.bed")
    sinks.write_regions(frame(spark, d, "v_promoter"), place)
    return text.read_regions(spark, place).withColumnRenamed("end", "stop")


@query(sql("v_tss") + " SELECT chrom, start, stop FROM v_tss")
def tss_bed(spark, d):
    place = new_place(spark, "tss.bed")
    sinks.write_regions(frame(spark, d, "v_tss"), place)
    return text.read_bed3(spark, place).withColumnRenamed("end", "stop")


@query(
    sql("v_collapse") + ", c0 AS (SELECT chrom, start, stop, barcode, count(*) AS n FROM v_collapse GROUP BY 1, 2, 3, 4)"
    + _COL("c0", "chrom, start, barcode", "c1") + _COL("c1", "chrom, stop, barcode", "c2") + _COL("c2", "chrom, start, stop", "c3") + " SELECT chrom, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, barcode, CAST(n AS INT) AS n FROM c3"
)
def fragment_file(spark, d):
    place = new_place(spark, "fragments.bed")
    sinks.write_fragments(fragments.collapsed(frame(spark, d, "v_collapse")), place)
    return text.read_fragments(spark, place).withColumnRenamed("end", "stop").withColumnRenamed("count", "n")


@query("SELECT concat('chr', n_nationkey) AS chrom, CAST(4 * (n_nationkey + 3) AS BIGINT) AS length FROM nation")
def fasta_lengths(spark, d):
    records = table(spark, d, "nation", "concat('>chr', n_nationkey, ' made up\\n', repeat('ACGT', n_nationkey), '\\n', repeat('NNNN', 3)) as line")
    return text.fasta_lengths(spark, _lines(records, "line", new_place(spark, "a.fa")))


@query("SELECT concat('chr', n_nationkey) AS chrom, CAST(1000 * n_nationkey AS BIGINT) AS length FROM nation")
def chromosome_sizes(spark, d):
    place = new_place(spark, "a.sizes")
    table(spark, d, "nation", "concat('chr', n_nationkey) as chrom", "1000 * n_nationkey as length", "'more' as more").write.csv(place, sep="\t")
    return text.read_chromosome_sizes(spark, place)


@query(sql("v_cells") + " SELECT cell_id, barcode FROM v_cells")
def barcode_table(spark, d):
    place = new_place(spark, "barcodes")
    frame(spark, d, "v_cells").select("cell_id", "barcode").coalesce(1).write.csv(place, header=True)
    return text.read_barcodes(spark, place).select("cell_id", "barcode")


@query(sql("v_cells") + " SELECT barcode FROM v_cells")
def valid_barcodes(spark, d):
    place = new_place(spark, "valid.csv")
    frame(spark, d, "v_cells").select("cell_id", F.concat(F.lit(" "), "barcode").alias("barcode"), "ord").write.csv(place, ignoreLeadingWhiteSpace=False)
    return text.read_valid_barcodes(spark, place)


@query(sql("v_cells") + " SELECT DISTINCT barcode FROM v_cells")
def whitelist_lines(spark, d):
    return text.read_lines(spark, _lines(frame(spark, d, "v_cells").select("barcode").distinct(), "barcode", new_place(spark, "whitelist")))


@query(sql(*_QC_TABLES) + _QC + " SELECT bc AS barcode FROM qc WHERE total_frags >= 10")
def called_barcodes_file(spark, d):
    called = features.called_cells(_qc(spark, d), features.CellFilter(10, 10**9, 0.0, 0.0, 0.0, 0.0, 1.0))
    return text.cell_list(spark, _lines(called, "bc", new_place(spark, "barcodes.txt")), is_path=True)


# --- results ------------------------------------------------------------------------------


@query(sql("v_reads", "v_cells") + _ASSIGNED + " SELECT cell_id, gene_id, umi AS \"UMI\", CAST(-map_status AS INT) AS position FROM x WHERE cell_id IS NOT NULL AND gene_id IS NOT NULL AND flag & 4 = 0")
def cell_tables(spark, d):
    place = new_place(spark, "count")
    # cells are written as files of their own, so each is written by few tasks
    sinks.write_cell_tables(demux.cell_reads(_assigned(spark, d)).repartition("cell_id"), place)
    read = spark.read.option("recursiveFileLookup", "false").csv(place, header=True, schema="gene_id string, UMI string, position int, cell_id string")
    return read.select("cell_id", "gene_id", "UMI", "position")


@query(
    sql("v_reads", "v_cells") + _HIST + " SELECT 'chromosomes' AS name, rname AS key, count(*) AS n FROM v_reads WHERE flag & 4 = 0 GROUP BY 1, 2 UNION ALL SELECT 'barcodes', barcode, n FROM h"
)
def statistics_files(spark, d):
    place = new_place(spark, "stat")
    sinks.write_statistics({"chromosomes": demux.chromosome_statistics(frame(spark, d, "v_reads")), "barcodes": _hist(spark, d)}, place)
    read = [spark.read.csv(f"{place}/{n}", header=True).toDF("key", "n").select(F.lit(n).alias("name"), "key", F.col("n").cast("long").alias("n")) for n in ("chromosomes", "barcodes")]
    return read[0].unionByName(read[1])


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT feature, barcode, n FROM counts")
def matrix_file(spark, d):
    place = new_place(spark, "matrix")
    sinks.write_matrix(_counts(spark, d), place)
    return spark.read.parquet(place)


def _lane_counts(spark, d):
    rows = frame(spark, d, "v_umi").select("gene_id", F.concat(F.lit("line"), "pos").alias("cell_id"))
    return rows.groupBy("gene_id", "cell_id").agg(F.count("*").alias("n"))


def rna_folder(spark, d):
    """A counting run's folder, seven lanes as its cells."""
    place, counts = new_place(spark, "rna"), _lane_counts(spark, d)
    cells = counts.groupBy("cell_id").agg(F.sum("n").alias("mapped_to_exon"), F.count("*").alias("unaligned"))
    sinks.write_csv(umi.count_matrix(counts, [f"line{k}" for k in range(1, 8)]), f"{place}/gene_count.csv")
    sinks.write_csv(cells, f"{place}/stat/cell_stat.csv")
    sinks.write_csv(spark.createDataFrame([("barcode_match", 9), ("barcode_unmatch_aligned", 1)], "status string, count long"), f"{place}/stat/overall_stat.csv")
    sinks.write_csv(counts.groupBy(F.col("n").alias("duplication_number")).agg(F.count("*").alias("count")), f"{place}/stat/UMI_duplication_count.csv")
    return place


_LANES = ", lane AS (SELECT gene_id, concat('line', pos) AS cell_id, count(*) AS n FROM v_umi GROUP BY 1, 2)"


@query(sql("v_umi") + _LANES + " SELECT gene_id, cell_id, n FROM lane")
def rna_result_counts(spark, d):
    return text.read_rna_results(spark, rna_folder(spark, d))["counts"].where("n > 0")


@query(sql("v_umi") + _LANES + " SELECT cell_id, CAST(sum(n) AS BIGINT) AS mapped_to_exon, count(*) AS unaligned FROM lane GROUP BY 1")
def rna_result_cells(spark, d):
    return text.read_rna_results(spark, rna_folder(spark, d))["cell_stat"]


@query(sql("v_umi") + _LANES + " SELECT n AS duplication_number, count(*) AS \"count\" FROM lane GROUP BY 1")
def rna_result_duplication(spark, d):
    return text.read_rna_results(spark, rna_folder(spark, d))["duplication"]


def atac_folder(spark, d):
    place, made = new_place(spark, "atac"), _counts(spark, d)
    sinks.write_matrix(made, f"{place}/counts")
    counts = spark.read.schema(made.schema).parquet(f"{place}/counts")
    sinks.write_statistics({"per_cell": features.stats_per_cell(counts), "per_feature": features.stats_per_feature(counts), "cell_qc": rounded(_qc(spark, d), *_FRACTIONS)}, place)
    return place


@query(
    sql(*_QC_TABLES) + _COUNTS + _QC
    + ", pc AS (SELECT barcode AS cell, CAST(sum(n) AS DOUBLE) AS counts_per_cell, CAST(count(*) AS DOUBLE) AS features_per_cell FROM counts GROUP BY 1) SELECT pc.*, CAST(total_frags AS DOUBLE) AS total_frags, round(frac_peak, 6) AS frac_peak FROM pc LEFT JOIN qc ON qc.bc = pc.cell"
)
def atac_result_cells(spark, d):
    read = text.read_atac_results(spark, atac_folder(spark, d))
    made = experiment.from_atac_tables(read["counts"], read["per_cell"], read["cell_qc"], read["per_feature"])
    return made.cells.select("cell", "counts_per_cell", "features_per_cell", "total_frags", "frac_peak")


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT feature, CAST(sum(n) AS DOUBLE) AS counts_per_feature, CAST(count(*) AS DOUBLE) AS cells_per_feature FROM counts GROUP BY 1")
def atac_result_features(spark, d):
    return text.read_atac_results(spark, atac_folder(spark, d))["per_feature"].select("feature", "counts_per_feature", "cells_per_feature")


@query(sql("v_umi") + _UC + " SELECT 'counts' AS name, feature, barcode AS cell, n FROM uc UNION ALL SELECT 'cells', NULL, barcode, CAST(sum(n) AS BIGINT) FROM uc GROUP BY barcode UNION ALL SELECT 'features', feature, NULL, NULL FROM uc GROUP BY feature")
def experiment_folder(spark, d):
    counts = _umi_matrix(spark, d).withColumnRenamed("barcode", "cell")
    made = experiment.CellExperiment(counts, counts.groupBy("cell").agg(F.sum("n").alias("n")), counts.select("feature").distinct(), {"organism": "none"})
    place = new_place(spark, "experiment")
    made.save(place)
    back = experiment.CellExperiment.load(spark, place)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    parts = [
        back.counts.select(F.lit("counts").alias("name"), "feature", "cell", "n"),
        back.cells.select(F.lit("cells").alias("name"), none("feature", "string"), "cell", "n"),
        back.features.select(F.lit("features").alias("name"), "feature", none("cell", "string"), none("n", "long")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT 'nations' AS name, 25 AS n_rows, 2 AS headings UNION ALL SELECT 'regions', 3, 2")
def report_page(spark, d):
    place = new_place(spark, "report")
    nations, regions = table(spark, d, "nation", "n_nationkey", "n_name"), table(spark, d, "region", "r_regionkey", "'<b>' as r_name")
    sinks.write_report({"nations": nations, "regions": regions}, place, rows=25)
    sinks.write_report({"nations": nations.limit(0), "regions": regions}, f"{place}-short", rows=3)
    counted = lambda c, mark: F.size(F.split(c, mark)) - 1
    section = lambda name, c: spark.read.text(place if name == "nations" else f"{place}-short").select(F.lit(name).alias("name"), c.alias("part"))
    parts = section("nations", F.split("value", "<h2>")[1]).unionByName(section("regions", F.split("value", "<h2>")[2]))
    return parts.select("name", (counted("part", "<tr>") - 1).alias("n_rows"), counted("part", "<th>").alias("headings"))
