"""Queries of the experiment container and of whole runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import demux, experiment, qc, umi, workflows
from ..sources import text
from .assay import base4, frame, sql
from .catalog import query
from .files import _LANES, rna_folder
from .registry import _ASSIGNED, _COUNTS, _DUP, _FEATURES, _GENES, _INLINE, _PAIRS, _QC, _QC_TABLES, _THRESHOLDS, _UC, _assigned, _gene_counts, _pairs, _umi_matrix
from .steps import table

# --- the container ------------------------------------------------------------------------


def _experiment(spark, d):
    counts = _gene_counts(spark, d).select(F.col("gene_id").alias("feature"), F.col("cell_id").alias("cell"), "n")
    made = experiment.CellExperiment(counts, counts.select("cell").distinct(), counts.select("feature").distinct())
    made.qc_metrics = qc.gene_metrics(_gene_counts(spark, d)).withColumnRenamed("cell_id", "cell")
    made.demultiplex_info = demux.overall_statistics(_assigned(spark, d))
    made.umi_dup_info = umi.duplication_histogram(umi.corrected_pairs(_pairs(spark, d), 0))
    return made


@query(
    sql("v_reads") + _GENES + ", g AS (SELECT DISTINCT gene_id FROM gc) SELECT CASE WHEN count_if(starts_with(gene_id, 'ENSG')) > count(*) / 2 THEN 'hsapiens_gene_ensembl' END AS organism, CASE WHEN count_if(starts_with(gene_id, 'ENSG')) > count(*) / 2 THEN 'ensembl_gene_id' END AS gene_id_type, (SELECT count(DISTINCT cell_id) FROM gc) AS cells, count(*) AS features FROM g"
)
def experiment_validated(spark, d):
    made = _experiment(spark, d).validate()
    return made.cells.agg(F.count("*").alias("cells")).crossJoin(F.broadcast(made.features.agg(F.count("*").alias("features")))).withColumns({"organism": F.lit(made.organism), "gene_id_type": F.lit(made.gene_id_type)})


@query(sql("v_reads") + _GENES + " SELECT cell_id AS cell, count(*) AS number_of_genes, CAST(sum(n) AS BIGINT) AS total_count_per_cell FROM gc GROUP BY 1")
def experiment_qc_metrics(spark, d):
    return _experiment(spark, d).qc_metrics.select("cell", "number_of_genes", "total_count_per_cell")


@query(sql("v_reads", "v_cells") + _ASSIGNED + " SELECT 'barcode_match' AS status, count(*) AS \"count\" FROM x WHERE cell_id IS NOT NULL")
def experiment_demultiplexing(spark, d):
    return _experiment(spark, d).demultiplex_info.where("status = 'barcode_match'")


@query(sql("v_umi") + _PAIRS + _DUP + " SELECT * FROM hist WHERE duplication_number <= 20")
def experiment_duplication(spark, d):
    return _experiment(spark, d).umi_dup_info.where("duplication_number <= 20")


@query(sql("v_reads") + _GENES + " SELECT CAST(length(gene_id) AS INT) AS letters, count(*) AS n FROM (SELECT DISTINCT gene_id FROM gc) GROUP BY 1")
def experiment_feature_info(spark, d):
    made = _experiment(spark, d)
    made.feature_info = made.features.withColumn("letters", F.length("feature"))
    return made.feature_info.groupBy("letters").agg(F.count("*").alias("n"))


@query(sql("v_umi") + _LANES + " SELECT cell_id AS cell, count(*) AS features, CAST(sum(n) AS BIGINT) AS n FROM lane GROUP BY 1")
def experiment_from_rna_folder(spark, d):
    read = text.read_rna_results(spark, rna_folder(spark, d))
    made = experiment.from_rna_tables(read["counts"], read["cell_stat"], read["overall_stat"], read["duplication"])
    return made.counts.groupBy("cell").agg(F.count("*").alias("features"), F.sum("n").alias("n"))


def _umi_experiment(spark, d):
    counts = _umi_matrix(spark, d).select("feature", F.col("barcode").alias("cell"), "n")
    cells = counts.groupBy("cell").agg(F.sum("n").alias("total"))
    return experiment.CellExperiment(counts, cells, counts.select("feature").distinct())


@query(sql("v_umi") + _UC + f", s AS (SELECT CAST(s_suppkey AS VARCHAR) AS barcode, {base4('s_suppkey', 8)} AS named FROM supplier) SELECT feature, named AS cell, n FROM uc JOIN s ON s.barcode = uc.barcode")
def cells_renamed(spark, d):
    names = table(spark, d, "supplier", "cast(s_suppkey as string) as cell_name", f"{base4('s_suppkey', 8)} as barcode_sequence")
    return experiment.rename_cells(_umi_experiment(spark, d), names).counts.select("feature", "cell", "n")


def _two(spark, d):
    one = _umi_experiment(spark, d)
    cells = table(spark, d, "customer", "concat('a', c_custkey) as cell", "c_nationkey as nation")
    counts = table(spark, d, "customer", "concat('f', c_nationkey) as feature", "concat('a', c_custkey) as cell", "1L as n")
    two = experiment.CellExperiment(counts, cells, counts.select("feature").distinct())
    matches = table(spark, d, "customer", "cast(c_custkey as string) as one", "concat('a', c_custkey) as two")
    lines = table(spark, d, "customer", "concat('a', c_custkey) as barcode", "case when c_custkey % 3 = 0 then c_mktsegment end as cell_line")
    return experiment.integrate({"one": one, "two": two}, matches, cell_lines={"two": lines})


_INTEGRATED = ", t AS (SELECT barcode, CAST(sum(n) AS BIGINT) AS total FROM uc GROUP BY 1), m AS (SELECT CAST(c_custkey AS VARCHAR) AS one, concat('a', c_custkey) AS two, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS line FROM customer)"


@query(sql("v_umi") + _UC + _INTEGRATED + " SELECT coalesce(t.barcode, m.one) AS one, total AS one_total, m.two, nation AS two_nation, line AS two_cell_line FROM t FULL JOIN m ON m.one = t.barcode")
def integrated_metrics(spark, d):
    return _two(spark, d)[1].select("one", "one_total", "two", "two_nation", "two_cell_line")


@query(sql("v_umi") + _UC + _INTEGRATED + " SELECT m.two AS cell, nation, line AS cell_line, t.barcode IS NOT NULL AND line IS NOT NULL AS shared FROM m LEFT JOIN t ON t.barcode = m.one")
def integrated_cells(spark, d):
    return _two(spark, d)[0]["two"].cells.select("cell", "nation", "cell_line", "shared")


# --- runs ---------------------------------------------------------------------------------


@query(sql("v_pairs") + " SELECT ordinal, concat(substr(seq1, 1, 2), substr(seq2, 7, 8), '_', substr(seq2, 1, 6), '#', name) AS name, substr(seq1, 3) AS seq, substr(qual1, 3) AS qual FROM v_pairs WHERE NOT contains(substr(seq1, 1, 2), 'N') AND NOT contains(substr(seq2, 1, 14), 'N') AND length(regexp_replace(substr(qual2, 1, 14), '[^#]', '', 'g')) <= 3")
def trim_barcode_run(spark, d):
    return workflows.trim_barcode(frame(spark, d, "v_pairs"), sq.ReadStructure(0, 2, 6, 8, 0, 6), sq.FilterSettings(minq=10, numbq=3))[0]


@query(sql("v_pairs", "v_cells") + _INLINE + " SELECT ordinal, name1, match_type, status FROM t")
def atac_trim_run(spark, d):
    made, _ = workflows.atac_trim(frame(spark, d, "v_pairs"), frame(spark, d, "v_cells"), False, 0, 6, rmlow=False, reverse_complement=False)
    return made.select("ordinal", "name1", "match_type", "status")


@query(
    sql("v_reads", "v_cells") + _ASSIGNED
    + ", k AS (SELECT DISTINCT cell_id, gene_id, umi, map_status FROM x WHERE cell_id IS NOT NULL AND gene_id IS NOT NULL AND flag & 4 = 0) SELECT gene_id AS feature, cell_id AS cell, count(*) AS n FROM k GROUP BY 1, 2"
)
def counting_run(spark, d):
    return workflows.demultiplex_and_count(frame(spark, d, "v_reads"), frame(spark, d, "v_cells"), mito="chr7", mode=0).counts.select("feature", "cell", "n")


_CALLED = (
    _COUNTS + _QC
    + ", ca AS (SELECT bc FROM qc WHERE total_frags BETWEEN 10 AND 100000 AND frac_peak >= 0.2 AND frac_promoter >= 0.1 AND frac_mito <= 0.15), k0 AS (SELECT * FROM counts WHERE barcode IN (SELECT bc FROM ca))"
    + ", c1 AS (SELECT barcode FROM k0 GROUP BY 1 HAVING sum(n) > 20), k1 AS (SELECT * FROM k0 WHERE (SELECT count(*) FROM c1) < 10 OR barcode IN (SELECT barcode FROM c1))"
    + ", c2 AS (SELECT feature FROM k1 GROUP BY 1 HAVING sum(n) > 10), k2 AS (SELECT feature, barcode, n FROM k1 WHERE (SELECT count(*) FROM c2) < 10 OR feature IN (SELECT feature FROM c2))"
)


def _feature_run(spark, d):
    regions = [frame(spark, d, f"v_{n}") for n in ("feat", "promoter", "tss", "enhancer")]
    return workflows.feature_counting(frame(spark, d, "v_frag"), *regions, thresholds=_THRESHOLDS, cell_above=20, feature_above=10, mito="chr7")


@query(sql(*_QC_TABLES) + _CALLED + " SELECT feature, barcode, n FROM k2")
def feature_counting_run(spark, d):
    return _feature_run(spark, d)["counts"].select("feature", "barcode", "n")


@query(sql(*_QC_TABLES) + _CALLED + " SELECT barcode AS cell, CAST(sum(n) AS BIGINT) AS counts_per_cell, total_frags FROM k2 JOIN qc ON qc.bc = k2.barcode GROUP BY barcode, total_frags")
def atac_experiment_cells(spark, d):
    return workflows.atac_experiment(_feature_run(spark, d)).cells.select("cell", "counts_per_cell", "total_frags")


@query(
    sql("v_ends", "v_feat", "v_promoter", "v_tss", "v_enhancer") + ", g AS (SELECT rname, qname, count(*) AS n, max(CASE WHEN NOT reverse THEN coordinate END) AS s, max(CASE WHEN reverse THEN coordinate END) AS e, min_by(barcode, CASE WHEN barcode IS NOT NULL THEN ord END) AS barcode FROM v_ends GROUP BY 1, 2)"
    + ", p AS (SELECT rname AS chrom, CAST(s AS INT) AS start, CAST(e AS INT) AS stop, barcode FROM g WHERE n = 2 AND barcode IS NOT NULL AND e - s BETWEEN 10 AND 5000)"
    + ", f0 AS (SELECT chrom, start, stop, barcode, count(*) AS n FROM p GROUP BY 1, 2, 3, 4)"
    + "".join(
        f", {out} AS (SELECT chrom, start, stop, barcode, CAST(total AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, concat_ws('|', chrom, start, stop, barcode)) AS k FROM {src}) WHERE k = 1)"
        for src, by, out in (("f0", "chrom, start, barcode", "f1"), ("f1", "chrom, stop, barcode", "f2"), ("f2", "chrom, start, stop", "v_frag"))
    )
    + _FEATURES
    + ", counts AS (SELECT feature, barcode, count(*) AS n FROM v_frag f JOIN feat t ON f.chrom = t.chrom AND f.start <= t.stop AND f.stop >= t.start GROUP BY 1, 2) SELECT feature, barcode, n FROM counts"
)
def atac_run_counts(spark, d):
    # alignments whose ends are those of v_ends: a forward one begins four bases earlier, a reverse one is one base long and ends five later
    ends = frame(spark, d, "v_ends")
    at = F.when(F.col("reverse"), F.col("coordinate") + 4).otherwise(F.col("coordinate") - 4)
    rows = ends.select("qname", F.when(F.col("reverse"), 16).otherwise(0).alias("flag"), "rname", at.cast("int").alias("pos"), F.lit(60).alias("mapq"), F.lit("1M").alias("cigar"), F.lit(0).alias("pnext"), F.col("barcode").alias("cell_bc"), F.col("ord").alias("ordinal"))
    regions = [frame(spark, d, f"v_{n}") for n in ("feat", "promoter", "tss", "enhancer")]
    # ends begin at 0, so their alignments begin four bases before; moved places would change the order of equal fragments' keys
    _, tables = workflows.atac_run(rows, *regions, mito="chr7", first=-4)
    return tables["unfiltered"].select("feature", "barcode", "n")


@query(
    sql("v_reads", "v_cells") + _ASSIGNED
    + ", k AS (SELECT DISTINCT cell_id, gene_id, umi, map_status FROM x WHERE cell_id IS NOT NULL AND gene_id IS NOT NULL AND flag & 4 = 0), ct AS (SELECT gene_id, cell_id, count(*) AS n FROM k GROUP BY 1, 2), nc AS (SELECT count(DISTINCT cell_id) AS c FROM v_cells)"
    + ", u AS (SELECT gene_id FROM ct GROUP BY 1 HAVING avg(n) > 1.1 AND count(*) > 5), used AS (SELECT count(*) AS c FROM ct WHERE gene_id IN (SELECT gene_id FROM u))"
    + " SELECT 'mapping' AS name, 6 * c AS n FROM nc UNION ALL SELECT 'mapping_share', 6 * c FROM nc UNION ALL SELECT 'demultiplexing', 6 UNION ALL SELECT 'metrics', count(DISTINCT cell_id) FROM ct UNION ALL SELECT 'metric_correlations', 1 UNION ALL SELECT 'cpm', c FROM used UNION ALL SELECT 'log', c FROM used UNION ALL SELECT 'variable', least(500, count(*)) FROM u UNION ALL SELECT 'components', count(DISTINCT cell_id) FROM ct WHERE gene_id IN (SELECT gene_id FROM u) UNION ALL SELECT 'tree', greatest(least(50, count(*)) - 1, 0) FROM u"
)
def report_tables(spark, d):
    made = workflows.rna_report(workflows.demultiplex_and_count(frame(spark, d, "v_reads"), frame(spark, d, "v_cells"), mito="chr7", mode=0))
    counted = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in made.items() if n != "duplication"]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out
