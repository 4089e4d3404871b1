"""Queries of the operators by name, and the SQL that says the same.

Each runs over whole tables of the virtual assay.  Doubles are rounded in both to
six digits.  Further queries are in `steps`, `files`, `containers` and `streams`;
importing this module registers them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import barcodes as bc
from ..operators import demux, experiment, features, fragments, intervals, mapping, matrix, qc, reads, umi
from ..operators.annotation import convert_ids
from .assay import base4, frame, sql
from .catalog import ORACLE_SQL, QUERIES, query, rounded

__all__ = ["ORACLE_SQL", "QUERIES"]


# --- fragments on features ----------------------------------------------------------------

_FEATURES = ", feat AS (SELECT DISTINCT chrom, start, stop, concat(chrom, ':', start, '-', stop) AS feature FROM v_feat)"
_COUNTS = _FEATURES + ", counts AS (SELECT feature, barcode, count(*) AS n FROM v_frag f JOIN feat t ON f.chrom = t.chrom AND f.start <= t.stop AND f.stop >= t.start GROUP BY 1, 2)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_counts(frame(spark, d, "v_frag"), frame(spark, d, "v_feat"))


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT feature, barcode, n FROM counts")
def feature_barcode_counts(spark, d):
    return _counts(spark, d)


@query(sql("v_feat", "v_black") + _FEATURES + " SELECT chrom, start, stop, feature FROM feat t WHERE NOT EXISTS (SELECT 1 FROM v_black b WHERE b.chrom = t.chrom AND b.start <= t.stop AND b.stop >= t.start)")
def features_excluding_blacklist(spark, d):
    kept, _ = features.exclude_regions(features.distinct_features(frame(spark, d, "v_feat")), frame(spark, d, "v_black"))
    return kept.withColumnRenamed("end", "stop")


@query(sql("v_feat", "v_black") + _FEATURES + " SELECT count(*) AS n_excluded FROM feat t JOIN v_black b ON b.chrom = t.chrom AND b.start <= t.stop AND b.stop >= t.start")
def excluded_pairs(spark, d):
    return features.exclude_regions(features.distinct_features(frame(spark, d, "v_feat")), frame(spark, d, "v_black"))[1]


_QC = """, frag AS (SELECT *,
 EXISTS (SELECT 1 FROM v_feat t WHERE t.chrom = f.chrom AND t.start <= f.stop AND t.stop >= f.start) AS p,
 EXISTS (SELECT 1 FROM v_promoter t WHERE t.chrom = f.chrom AND t.start <= f.stop AND t.stop >= f.start) AS r,
 EXISTS (SELECT 1 FROM v_tss t WHERE t.chrom = f.chrom AND t.start - 1001 <= f.stop AND t.stop + 1001 >= f.start) AS s,
 EXISTS (SELECT 1 FROM v_enhancer t WHERE t.chrom = f.chrom AND t.start <= f.stop AND t.stop >= f.start) AS e FROM v_frag f),
 qc AS (SELECT barcode AS bc, count(*) AS total_frags, avg(p::int) AS frac_peak, avg(r::int) AS frac_promoter, avg(s::int) AS frac_tss, avg(e::int) AS frac_enhancer,
 avg((chrom = 'chr7')::int) AS frac_mito FROM frag GROUP BY 1 HAVING count(*) > 5)"""
_QC_TABLES = ("v_frag", "v_feat", "v_promoter", "v_tss", "v_enhancer")
_FRACTIONS = ("frac_peak", "frac_promoter", "frac_tss", "frac_enhancer", "frac_mito")
_QC_COLUMNS = "bc, total_frags, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FRACTIONS)


def _qc(spark: SparkSession, d: str) -> DataFrame:
    placed = frame(spark, d, "v_frag").withColumn("place", F.concat_ws(":", "chrom", "start", "end"))
    regions = {n: frame(spark, d, f"v_{n}") for n in ("feat", "promoter", "tss", "enhancer")}
    return features.cell_qc_metrics(placed, "place", regions["feat"], regions["promoter"], regions["tss"], regions["enhancer"], mito="chr7")


@query(sql(*_QC_TABLES) + _QC + f" SELECT {_QC_COLUMNS} FROM qc")
def cell_qc_metrics(spark, d):
    return rounded(_qc(spark, d), *_FRACTIONS)


_THRESHOLDS = features.CellFilter(min_uniq_frags=10, max_uniq_frags=100000, min_frac_peak=0.2, min_frac_promoter=0.1, max_frac_mito=0.15)


@query(sql(*_QC_TABLES) + _QC + f" SELECT {_QC_COLUMNS} FROM qc WHERE total_frags BETWEEN 10 AND 100000 AND frac_peak >= 0.2 AND frac_tss >= 0 AND frac_enhancer >= 0 AND frac_promoter >= 0.1 AND frac_mito <= 0.15")
def filter_cell_calling(spark, d):
    return rounded(features.called_cells(_qc(spark, d), _THRESHOLDS), *_FRACTIONS)


@query(sql(*_QC_TABLES) + _QC + " SELECT bc, (total_frags BETWEEN 10 AND 100000 AND frac_peak >= 0.2 AND frac_promoter >= 0.1 AND frac_mito <= 0.15) AS cell_called FROM qc")
def cell_called_flags(spark, d):
    metrics = _qc(spark, d)
    return features.flag_called(metrics, features.called_cells(metrics, _THRESHOLDS)).select("bc", "cell_called")


@query(sql(*_QC_TABLES) + _QC + " SELECT " + ", ".join(f"round(sum(total_frags * {c}) / sum(total_frags), 6) AS {c}" for c in _FRACTIONS) + " FROM qc")
def overall_fractions(spark, d):
    return rounded(features.weighted_fractions(_qc(spark, d)), *_FRACTIONS)


@query(
    sql("v_frag", "v_feat") + _COUNTS
    + ", c1 AS (SELECT barcode FROM counts GROUP BY 1 HAVING sum(n) > 20), k1 AS (SELECT * FROM counts WHERE (SELECT count(*) FROM c1) < 10 OR barcode IN (SELECT barcode FROM c1))"
    + ", c2 AS (SELECT feature FROM k1 GROUP BY 1 HAVING sum(n) > 10) SELECT feature, barcode, n FROM k1 WHERE (SELECT count(*) FROM c2) < 10 OR feature IN (SELECT feature FROM c2)"
)
def count_filtered_matrix(spark, d):
    return features.filter_counts(_counts(spark, d), 20, 10).select("feature", "barcode", "n")


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT barcode AS cell, CAST(sum(n) AS BIGINT) AS counts_per_cell, count(*) AS features_per_cell FROM counts GROUP BY 1")
def stats_per_cell(spark, d):
    return features.stats_per_cell(_counts(spark, d))


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT feature, CAST(sum(n) AS BIGINT) AS counts_per_feature, count(*) AS cells_per_feature FROM counts GROUP BY 1")
def stats_per_feature(spark, d):
    return features.stats_per_feature(_counts(spark, d))


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT round(sum(n) / count(DISTINCT barcode), 6) AS average FROM counts")
def average_fragments(spark, d):
    return rounded(features.average_fragments_per_barcode(_counts(spark, d)), "average")


@query(sql("v_frag", "v_feat") + _COUNTS + " SELECT feature, barcode, CAST(1 AS BIGINT) AS n FROM counts WHERE n > 0")
def binary_matrix(spark, d):
    return features.binary(_counts(spark, d)).select("feature", "barcode", "n")


def _exists(name: str, alias: str) -> str:
    return f"EXISTS (SELECT 1 FROM {name} x WHERE x.chrom = t.chrom AND x.start <= t.stop AND x.stop >= t.start) AS {alias}"


@query(
    sql("v_feat", "v_promoter", "v_enhancer", "v_tss", "v_exon") + _FEATURES
    + f", f AS (SELECT feature, {_exists('v_promoter', 'promoter_overlaps')}, {_exists('v_enhancer', 'enhancer_overlaps')}, {_exists('v_tss', 'tss_overlaps')}, {_exists('v_exon', 'gene_overlaps')} FROM feat t)"
    + " SELECT *, NOT gene_overlaps AS intergenic FROM f"
)
def feature_annotation_flags(spark, d):
    feats = features.distinct_features(frame(spark, d, "v_feat"))
    made = features.feature_flags(feats, *[frame(spark, d, n) for n in ("v_promoter", "v_enhancer", "v_tss", "v_exon")])
    return made.select("feature", "promoter_overlaps", "enhancer_overlaps", "tss_overlaps", "gene_overlaps", "intergenic")


_BINS = "WITH c AS (SELECT concat('chr', n_nationkey) AS chrom, CAST(n_nationkey * 1700 + 501 AS BIGINT) AS length FROM nation)"


@query(_BINS + " SELECT chrom, CAST(k * 500 + 1 AS BIGINT) AS start, CAST(least((k + 1) * 500, length) AS BIGINT) AS stop FROM c, generate_series(0, 200) g(k) WHERE k < ceil(length / 500.0)")
def genome_bins(spark, d):
    c = spark.read.parquet(f"{d}/nation.parquet").selectExpr("concat('chr', n_nationkey) as chrom", "cast(n_nationkey * 1700 + 501 as long) as length")
    return intervals.tiles(c, 500).withColumnRenamed("end", "stop")


_TSS = """, b AS (SELECT tss_id, k, chrom, start - 1950 + 100 * k AS lo, start - 1950 + 100 * k + 99 AS hi FROM v_tss, generate_series(0, 38) g(k)),
 h AS (SELECT tss_id, k, count(f.chrom) AS n FROM b LEFT JOIN v_frag f ON f.chrom = b.chrom AND f.start <= b.hi AND f.stop >= b.lo GROUP BY 1, 2),
 o AS (SELECT tss_id, sum(n) / 2.0 AS flank FROM h WHERE k IN (0, 38) GROUP BY 1 HAVING sum(n) > 0),
 p AS (SELECT CAST(k * 100 - 1900 AS INT) AS dists, avg(n / flank) AS agg_tss_scores FROM h JOIN o USING (tss_id) GROUP BY k)"""


@query(sql("v_frag", "v_tss") + _TSS + " SELECT dists, round(agg_tss_scores, 6) AS agg_tss_scores FROM p")
def tss_bin_profile(spark, d):
    return rounded(features.tss_profile(frame(spark, d, "v_frag"), frame(spark, d, "v_tss"), "tss_id"), "agg_tss_scores")


@query(sql("v_frag", "v_tss") + _TSS + " SELECT round(max(agg_tss_scores), 6) AS tsse FROM p")
def tss_enrichment_score(spark, d):
    return rounded(features.tss_enrichment(features.tss_profile(frame(spark, d, "v_frag"), frame(spark, d, "v_tss"), "tss_id")), "tsse")


@query(sql("v_frag", "v_enhancer") + " SELECT barcode, count(*) AS n FROM v_frag f JOIN v_enhancer t ON f.chrom = t.chrom AND f.start <= t.stop + 1 AND t.start <= f.stop + 1 GROUP BY 1")
def bookended_overlap_counts(spark, d):
    hits = intervals.overlap_join(frame(spark, d, "v_frag"), frame(spark, d, "v_enhancer"), gap=1)
    return hits.groupBy("barcode").agg(F.count("*").alias("n"))


@query(sql("v_frag") + " SELECT CAST(floor((stop - start) / 10.0) * 10 AS BIGINT) AS size, count(*) AS n FROM v_frag WHERE stop - start < 800 GROUP BY 1")
def insert_size_hist(spark, d):
    return features.insert_sizes(frame(spark, d, "v_frag"))


# --- reads --------------------------------------------------------------------------------

_LOW = lambda q, n: f"length(regexp_replace(substr({q}, 1, {n}), '[^#5]', '', 'g')) > 2"
_TRIM = (
    ", t AS (SELECT ordinal, concat(substr(seq1, 1, 2), substr(seq2, 7, 8), '_', substr(seq2, 1, 6), '#', name) AS name, substr(seq1, 3) AS seq, substr(qual1, 3) AS qual, "
    f"CASE WHEN {_LOW('qual1', 2)} OR {_LOW('qual2', 14)} THEN 'low_quality' WHEN contains(substr(seq1, 1, 2), 'N') OR contains(substr(seq2, 1, 14), 'N') THEN 'has_n' ELSE 'pass' END AS status FROM v_pairs)"
)


def _trimmed(spark: SparkSession, d: str) -> DataFrame:
    return reads.trim_paired(frame(spark, d, "v_pairs"), sq.ReadStructure(0, 2, 6, 8, 0, 6), sq.FilterSettings())


@query(sql("v_pairs") + _TRIM + " SELECT ordinal, name, seq, qual, status FROM t")
def trim_read_names(spark, d):
    return _trimmed(spark, d)


@query(sql("v_pairs") + _TRIM + " SELECT count_if(status = 'pass') AS passed, count_if(status = 'has_n') AS removed_n, count_if(status = 'low_quality') AS removed_low_quality FROM t")
def trim_summary(spark, d):
    return reads.trim_summary(_trimmed(spark, d)).select(*[F.col(c).cast("long").alias(c) for c in ("passed", "removed_n", "removed_low_quality")])


@query(sql("v_pairs") + " SELECT ordinal, CAST(length(regexp_replace(qual2, '[^#5]', '', 'g')) AS INT) AS low FROM v_pairs WHERE length(regexp_replace(qual2, '[^#5]', '', 'g')) > 6")
def low_quality_filter(spark, d):
    return frame(spark, d, "v_pairs").select("ordinal", sq.low_quality_count("qual2", 20).alias("low")).where("low > 6")


@query(sql("v_pairs") + " SELECT ordinal, seq2 FROM v_pairs WHERE NOT contains(seq2, 'N')")
def n_filter(spark, d):
    return frame(spark, d, "v_pairs").where(~sq.has_n("seq2")).select("ordinal", "seq2")


@query(sql("v_pairs") + " SELECT ordinal, reverse(translate(seq1, 'ACGT', 'TGCA')) AS rc FROM v_pairs")
def reverse_complement(spark, d):
    return frame(spark, d, "v_pairs").select("ordinal", sq.reverse_complement("seq1").alias("rc"))


@query(sql("v_pairs") + " SELECT ordinal, CAST(hamming(substr(seq1, 1, 8), substr(seq2, 1, 8)) AS INT) AS d FROM v_pairs")
def hamming_pairs(spark, d):
    return frame(spark, d, "v_pairs").select("ordinal", sq.hamming(F.substring("seq1", 1, 8), F.substring("seq2", 1, 8)).alias("d"))


@query(sql("v_pairs") + " SELECT ordinal, CAST(levenshtein(seq1, seq2) AS INT) AS d FROM v_pairs")
def edit_distance_pairs(spark, d):
    return frame(spark, d, "v_pairs").select("ordinal", sq.edit_distance("seq1", "seq2").alias("d"))


_VALID = ", w AS (SELECT DISTINCT substr(barcode, 1, 6) AS barcode FROM v_cells)"
_SEEN = ", s AS (SELECT DISTINCT substr(seq2, 1, 6) AS seen FROM v_pairs WHERE NOT contains(substr(seq2, 1, 6), 'N'))"


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "v_pairs").select(F.substring("seq2", 1, 6).alias("seen")).where("not contains(seen, 'N')")


@query(sql("v_reads", "v_cells") + ", p AS (SELECT DISTINCT r.cell_bc AS seen, c.barcode, hamming(r.cell_bc, c.barcode) AS d FROM (SELECT DISTINCT cell_bc FROM v_reads) r, v_cells c WHERE hamming(r.cell_bc, c.barcode) <= 2), m AS (SELECT seen, min(d) AS d FROM p GROUP BY 1) SELECT p.seen, min(p.barcode) AS barcode, CAST(min(p.d) AS INT) AS distance FROM p JOIN m ON p.seen = m.seen AND p.d = m.d GROUP BY 1 HAVING count(*) = 1")
def nearest_unique_barcode(spark, d):
    return bc.nearest_unique(frame(spark, d, "v_reads").withColumnRenamed("cell_bc", "seen"), frame(spark, d, "v_cells"), 2)


@query(sql("v_reads", "v_cells") + " SELECT r.cell_bc AS seen, min(c.barcode) AS barcode FROM (SELECT DISTINCT cell_bc FROM v_reads) r JOIN v_cells c ON hamming(r.cell_bc, c.barcode) <= 1 GROUP BY 1")
def first_barcode_within(spark, d):
    return bc.first_within(frame(spark, d, "v_reads").withColumnRenamed("cell_bc", "seen"), frame(spark, d, "v_cells"), 1)


@query(
    sql("v_pairs", "v_cells") + _VALID + _SEEN
    + ", x AS (SELECT seen, max(k) AS d FROM s, generate_series(0, 6) g(k) WHERE EXISTS (SELECT 1 FROM w WHERE substr(w.barcode, 1, k) = substr(s.seen, 1, k)) GROUP BY 1)"
    + " SELECT DISTINCT seen, barcode, CAST(CASE WHEN d = 6 THEN -1 ELSE d END AS INT) AS position FROM x JOIN w ON (d = 6 AND barcode = seen) OR (d < 6 AND substr(barcode, 1, d) = substr(seen, 1, d) AND substr(barcode, d + 2) = substr(seen, d + 2))"
)
def prefix_mismatch_barcode(spark, d):
    return bc.prefix_match(_seen(spark, d), frame(spark, d, "v_cells")).select("seen", "barcode", "position")


@query(sql("v_pairs", "v_cells") + _VALID + ", h AS (SELECT k, count(*) AS n FROM v_pairs, generate_series(0, 8) g(k) WHERE substr(seq2, CAST(k AS INT) + 1, 6) IN (SELECT barcode FROM w) GROUP BY 1) SELECT CAST(k AS INT) AS position, n AS hits FROM h")
def barcode_start_position(spark, d):
    return bc.position_hits(frame(spark, d, "v_pairs"), frame(spark, d, "v_cells"), 9, 6, "seq2")


@query(sql("v_pairs", "v_cells") + _VALID + " SELECT count(*) AS missed, count(*) >= 4000 AS reverse FROM v_pairs WHERE ordinal < 10000 AND substr(seq2, 1, 6) NOT IN (SELECT barcode FROM w)")
def revcomp_decision(spark, d):
    return bc.needs_reverse_complement(frame(spark, d, "v_pairs"), frame(spark, d, "v_cells"), 0, 6, "seq2")


_INLINE = (
    _VALID
    + ", q AS (SELECT DISTINCT substr(seq1, 1, 6) AS b FROM v_pairs UNION SELECT DISTINCT substr(seq2, 1, 6) FROM v_pairs), k AS (SELECT b, min(CASE WHEN b = barcode THEN 0 WHEN hamming(b, barcode) <= 1 THEN 1 ELSE 2 END) AS kind FROM q, w GROUP BY 1)"
    + ", t AS (SELECT ordinal, concat(substr(seq1, 1, 6), '#', name) AS name1, substr(seq2, 7) AS seq2, CASE greatest(a.kind, c.kind) WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'none' END AS match_type,"
    + " CASE WHEN contains(substr(seq1, 1, 6), 'N') OR contains(substr(seq2, 1, 6), 'N') THEN 'has_n' ELSE 'pass' END AS status FROM v_pairs JOIN k a ON a.b = substr(seq1, 1, 6) JOIN k c ON c.b = substr(seq2, 1, 6))"
)


def _inline(spark: SparkSession, d: str) -> DataFrame:
    return reads.with_inline_barcodes(frame(spark, d, "v_pairs"), frame(spark, d, "v_cells"), (0, 6), (0, 6), rmN=True)


@query(sql("v_pairs", "v_cells") + _INLINE + " SELECT ordinal, name1, seq2, match_type, status FROM t")
def inline_barcode_match(spark, d):
    return _inline(spark, d).select("ordinal", "name1", "seq2", "match_type", "status")


@query(
    sql("v_pairs", "v_cells") + _INLINE
    + " SELECT count(*) AS total, count_if(status = 'has_n') AS removed_has_n, count_if(status = 'low_quality') AS removed_low_quality, count_if(status = 'pass' AND match_type = 'exact') AS exact_match, count_if(status = 'pass' AND match_type = 'partial') AS partial_match, count_if(status = 'pass' AND match_type = 'none') AS none_match, count(DISTINCT substr(name1, 1, 6)) AS barcodes_seen FROM t"
)
def inline_match_summary(spark, d):
    return reads.match_summary(_inline(spark, d))


@query(sql("v_reads") + " SELECT read_id, cell_bc, umi FROM v_reads")
def tags_from_names(spark, d):
    named = frame(spark, d, "v_reads").select("read_id", F.concat("cell_bc", F.lit("_"), "umi", F.lit("#"), "qname").alias("qname"))
    return reads.tag_from_name(named).select("read_id", "cell_bc", "umi")


_HIST = ", h AS (SELECT substr(cell_bc, 1, 6) AS barcode, count(*) AS n FROM v_reads GROUP BY 1)"


def _hist(spark: SparkSession, d: str) -> DataFrame:
    named = frame(spark, d, "v_reads").select(F.concat("cell_bc", "qname").alias("name"), F.col("read_id").alias("ordinal"))
    return bc.histogram(named, 6, max_reads=0)


@query(sql("v_reads") + _HIST + ", k AS (SELECT *, row_number() OVER (ORDER BY n DESC, barcode DESC) AS r FROM h QUALIFY r <= 50) SELECT concat('CELL_', lpad(CAST(r AS VARCHAR), CAST(length(CAST((SELECT count(*) FROM k) AS VARCHAR)) + 1 AS INT), '0')) AS cell_name, barcode AS barcode_sequence, n AS \"count\" FROM k")
def barcode_histogram_topk(spark, d):
    return bc.ranked_cells(_hist(spark, d), 50)


@query(sql("v_reads", "v_cells") + _HIST + ", p AS (SELECT h.barcode AS seen, c.barcode, hamming(h.barcode, c.barcode) AS d, h.n FROM h, (SELECT DISTINCT barcode FROM v_cells) c WHERE hamming(h.barcode, c.barcode) <= 1 QUALIFY row_number() OVER (PARTITION BY seen ORDER BY d, c.barcode) = 1) SELECT barcode, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1")
def barcode_whitelist_merge(spark, d):
    return bc.merge_into_whitelist(_hist(spark, d), frame(spark, d, "v_cells"), 1)


@query()
def barcode_neighbour_merge(spark, d):
    return bc.merge_neighbours(_hist(spark, d), 2, 1)


# --- demultiplexing -----------------------------------------------------------------------

_ASSIGNED = ", p AS (SELECT r.cell_bc, c.cell_id, hamming(r.cell_bc, c.barcode) AS d FROM (SELECT DISTINCT cell_bc FROM v_reads) r, v_cells c WHERE hamming(r.cell_bc, c.barcode) <= 1), m AS (SELECT cell_bc, min(d) AS d FROM p GROUP BY 1), a AS (SELECT p.cell_bc, min(p.cell_id) AS cell_id FROM p JOIN m ON p.cell_bc = m.cell_bc AND p.d = m.d GROUP BY 1 HAVING count(*) = 1), x AS (SELECT r.*, a.cell_id FROM v_reads r LEFT JOIN a ON r.cell_bc = a.cell_bc)"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return demux.assign_cells(frame(spark, d, "v_reads"), frame(spark, d, "v_cells"), 1)


@query(
    sql("v_reads", "v_cells") + _ASSIGNED
    + ", y AS (SELECT CASE WHEN cell_id IS NOT NULL THEN 'barcode_match' WHEN flag & 4 <> 0 THEN 'barcode_unmatch_unaligned' WHEN gene_id IS NOT NULL THEN 'barcode_unmatch_mapped_to_exon' WHEN map_status = 1 THEN 'barcode_unmatch_ambiguous_mapping' WHEN map_status = 2 THEN 'barcode_unmatch_mapped_to_intron' ELSE 'barcode_unmatch_aligned' END AS status FROM x)"
    + ", s(status) AS (VALUES " + ", ".join(f"('{s}')" for s in demux.STATUSES) + ") SELECT s.status, count(y.status) AS \"count\" FROM s LEFT JOIN y ON s.status = y.status GROUP BY 1"
)
def demux_overall_stat(spark, d):
    return demux.overall_statistics(_assigned(spark, d))


@query(
    sql("v_reads", "v_cells") + _ASSIGNED
    + " SELECT c.cell_id, count_if(coalesce(flag & 4 <> 0, false)) AS unaligned, count_if(coalesce(flag & 4 = 0 AND gene_id IS NULL AND map_status NOT IN (1, 2), false)) AS aligned_unmapped, count_if(coalesce(flag & 4 = 0 AND gene_id IS NOT NULL, false)) AS mapped_to_exon,"
    + " count_if(coalesce(flag & 4 = 0 AND gene_id IS NULL AND map_status = 2, false)) AS mapped_to_intron, count_if(coalesce(flag & 4 = 0 AND gene_id IS NULL AND map_status = 1, false)) AS ambiguous_mapping, CAST(0 AS BIGINT) AS mapped_to_ERCC, count_if(coalesce(flag & 4 = 0 AND gene_id IS NOT NULL AND rname = 'chr7', false)) AS mapped_to_MT"
    + " FROM (SELECT DISTINCT cell_id FROM v_cells) c LEFT JOIN x ON c.cell_id = x.cell_id GROUP BY 1"
)
def demux_cell_stat(spark, d):
    return demux.cell_statistics(_assigned(spark, d), frame(spark, d, "v_cells"), mito="chr7")


@query(sql("v_reads") + " SELECT c.chromosome_name, count(r.rname) AS \"count\" FROM (SELECT concat('chr', k) AS chromosome_name FROM generate_series(1, 9) g(k)) c LEFT JOIN v_reads r ON r.rname = c.chromosome_name AND r.flag & 4 = 0 GROUP BY 1")
def demux_chrom_stat(spark, d):
    names = spark.range(1, 10).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("rname"))
    return demux.chromosome_statistics(frame(spark, d, "v_reads"), names)


@query(sql("v_reads", "v_cells") + _ASSIGNED + " SELECT cell_id, gene_id, umi AS \"UMI\", CAST(-map_status AS INT) AS position FROM x WHERE cell_id IS NOT NULL AND gene_id IS NOT NULL AND flag & 4 = 0")
def demux_cell_reads(spark, d):
    return demux.cell_reads(_assigned(spark, d))


_FLAGS = [99, 147, 83, 163, 73, 133, 77, 141, 67, 131, 81, 161, 0, 16]
_FLAG_SQL = "CASE event_id % 14 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FLAGS)) + " END"
_CLASS_SQL = "CASE " + " ".join(f"WHEN f IN ({', '.join(map(str, fs))}) THEN '{n}'" for n, fs in demux.FLAG_CLASSES.items()) + " END"


@query(
    f"WITH r AS (SELECT user_id, {_FLAG_SQL} AS f FROM events), t AS (SELECT CAST(user_id AS VARCHAR) AS barcode, {_CLASS_SQL} AS type FROM r) SELECT barcode, "
    + ", ".join(f"count_if(type = '{c}') AS {c}" for c in demux.CLASS_COLUMNS)
    + ", count(*) AS \"count\" FROM t WHERE type IS NOT NULL GROUP BY 1"
)
def mapping_stats_pivot(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("cast(user_id as string) as cell_bc", f"{_FLAG_SQL} as flag")
    return demux.flag_statistics(rows)


# --- annotation and exon mapping ----------------------------------------------------------

_FLAT = ", o AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY chrom, gene_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM v_exon), i AS (SELECT *, sum(opens) OVER (PARTITION BY chrom, gene_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o), flat AS (SELECT chrom, gene_id, CAST(min(start) AS INT) AS start, CAST(max(stop) AS INT) AS stop FROM i GROUP BY chrom, gene_id, island)"


@query(sql("v_exon") + _FLAT + " SELECT * FROM flat")
def exon_flatten(spark, d):
    return intervals.flatten(frame(spark, d, "v_exon"), ["chrom", "gene_id"]).withColumnRenamed("end", "stop").select("chrom", "gene_id", "start", "stop")


@query(sql("v_exon") + " SELECT chrom, gene_id, CAST(min(start) AS INT) AS start, CAST(max(stop) AS INT) AS stop, CAST(min(strand) AS INT) AS strand FROM v_exon GROUP BY 1, 2")
def gene_extent(spark, d):
    return intervals.extent(frame(spark, d, "v_exon"), ["chrom", "gene_id"], strand="strand").withColumnRenamed("end", "stop")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    exons = frame(spark, d, "v_exon")
    body = intervals.extent(exons, ["chrom", "gene_id"], strand="strand")
    parts = intervals.flatten(exons, ["chrom", "gene_id"]).groupBy("chrom", "gene_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return body.join(parts, ["chrom", "gene_id"])


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "v_aligned").groupBy("qname").agg(*[F.min(c).alias(c) for c in ("flag", "rname", "pos", "cigar")])


_HITS = (
    _FLAT
    + ", g AS (SELECT chrom, gene_id, min(start) AS gs, max(stop) AS ge, min(strand) AS strand FROM v_exon GROUP BY 1, 2)"
    + ", al AS (SELECT qname, min(flag) AS flag, min(rname) AS rname, min(pos) AS pos, min(cigar) AS cigar FROM v_aligned GROUP BY 1)"
    + ", c AS (SELECT *, CAST(regexp_extract(cigar, '^([0-9]+)M', 1) AS INT) AS m1, CAST(regexp_extract(cigar, 'M([0-9]+)N', 1) AS INT) AS nn, CASE WHEN flag & 16 <> 0 THEN -1 ELSE 1 END AS rs FROM al)"
    + ", seg AS (SELECT qname, rname AS chrom, 0 AS k, pos AS s, pos + m1 AS e, rs FROM c UNION ALL SELECT qname, rname, 2, pos + m1 + nn, pos + m1 + nn + 30, rs FROM c)"
    + ", body AS (SELECT seg.*, g.gene_id, g.strand, g.strand * rs <> -1 AS same FROM seg JOIN g ON g.chrom = seg.chrom AND s <= ge AND e >= gs)"
    # the first exon that a segment meets, and the lengths of the exons before and behind it
    + ", ex AS (SELECT *, stop - start AS len, sum(stop - start) OVER (PARTITION BY chrom, gene_id ORDER BY start) AS until, sum(stop - start) OVER (PARTITION BY chrom, gene_id) AS total FROM flat)"
    + ", met AS (SELECT qname, k, body.gene_id, min(start) AS first FROM body JOIN ex ON ex.chrom = body.chrom AND ex.gene_id = body.gene_id AND s <= ex.stop AND e >= ex.start WHERE same GROUP BY 1, 2, 3)"
    + ", hit AS (SELECT body.qname, body.k, body.gene_id, met.first IS NOT NULL AS ex, CASE body.strand WHEN 1 THEN ex.stop - greatest(ex.start, s) + ex.total - ex.until WHEN -1 THEN least(ex.stop, e) - ex.start + ex.until - ex.len ELSE 0 END AS rest"
    + " FROM body LEFT JOIN met ON met.qname = body.qname AND met.k = body.k AND met.gene_id = body.gene_id LEFT JOIN ex ON ex.chrom = body.chrom AND ex.gene_id = body.gene_id AND ex.start = met.first)"
    + ", v AS (SELECT seg.qname, seg.k, count(h.gene_id) AS bodies, count(DISTINCT CASE WHEN ex THEN h.gene_id END) AS n, min(CASE WHEN ex THEN h.gene_id END) AS gene, min(CASE WHEN ex THEN rest END) AS rest FROM seg LEFT JOIN hit h ON h.qname = seg.qname AND h.k = seg.k GROUP BY 1, 2)"
    + ", w AS (SELECT qname, k, CASE WHEN bodies = 0 THEN 3 WHEN n = 0 THEN 2 WHEN n = 1 THEN 0 ELSE 1 END AS code, CASE WHEN n = 1 THEN gene END AS gene, rest FROM v)"
    + ", z AS (SELECT qname, count(DISTINCT gene) AS n, min(code) AS least, min(gene) AS gene, max_by(rest, CASE WHEN code = 0 THEN k END) AS rest FROM w GROUP BY 1)"
    + ", voted AS (SELECT qname, CAST(CASE WHEN n = 1 THEN -rest WHEN n > 1 THEN 1 ELSE least END AS INT) AS map_status, CASE WHEN n = 1 THEN gene END AS gene_id FROM z)"
)


@query(sql("v_aligned", "v_exon") + _HITS + " SELECT qname, map_status, gene_id FROM voted")
def exon_vote(spark, d):
    return mapping.map_exons(_alignments(spark, d), _genes(spark, d)).select("qname", "map_status", "gene_id")


@query(
    sql("v_aligned", "v_exon") + _HITS
    + ", m AS (SELECT greatest(map_status, 0) AS code FROM voted) SELECT CAST(k AS INT) AS code, count(m.code) AS \"count\", round(100.0 * count(m.code) / (SELECT count(*) FROM m), 6) AS percent FROM generate_series(0, 4) g(k) LEFT JOIN m ON m.code = k GROUP BY 1"
)
def exon_mapping_summary(spark, d):
    return rounded(mapping.mapping_summary(mapping.map_exons(_alignments(spark, d), _genes(spark, d))), "percent")


# --- molecules ----------------------------------------------------------------------------

_PAIRS = ", pc AS (SELECT cell_id, gene_id, umi, pos, count(*) AS n FROM v_umi GROUP BY 1, 2, 3, 4)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return umi.pair_counts(frame(spark, d, "v_umi").select("cell_id", "gene_id", F.col("umi").alias("UMI"), F.col("pos").alias("position")))


@query(sql("v_umi") + _PAIRS + " SELECT gene_id, cell_id, count(*) AS n FROM pc GROUP BY 1, 2")
def umi_counts_raw(spark, d):
    return umi.gene_counts(umi.corrected_pairs(_pairs(spark, d), 0))


@query(sql("v_umi") + _PAIRS + " SELECT cell_id, count(*) AS filtered_gene FROM (SELECT cell_id, gene_id FROM pc GROUP BY 1, 2 HAVING sum(n) = 1) GROUP BY 1")
def umi_low_gene_filter(spark, d):
    return umi.low_gene_filter(_pairs(spark, d))[1]


_DUP = ", hist AS (SELECT CAST(k AS INT) AS duplication_number, count(pc.n) AS \"count\" FROM generate_series(1, 1001) g(k) LEFT JOIN pc ON least(pc.n, 1001) = k GROUP BY 1)"


@query(sql("v_umi") + _PAIRS + _DUP + " SELECT * FROM hist")
def umi_duplication_hist(spark, d):
    return umi.duplication_histogram(umi.corrected_pairs(_pairs(spark, d), 0))


@query(
    sql("v_umi") + _PAIRS + _DUP
    + ", s AS (SELECT duplication_number, \"count\", CAST(sum(\"count\") OVER (ORDER BY duplication_number) AS BIGINT) AS cumulative, sum(\"count\") OVER () AS total FROM hist WHERE duplication_number <= 1000) SELECT duplication_number, \"count\", cumulative FROM s WHERE duplication_number <= (SELECT min(duplication_number) FROM s WHERE total - cumulative < 10)"
)
def umi_dup_cumulative(spark, d):
    return qc.duplication_curve(umi.duplication_histogram(umi.corrected_pairs(_pairs(spark, d), 0)))


def _corrected(mode: int):
    def run(spark, d):
        return umi.gene_counts(umi.corrected_pairs(_pairs(spark, d), mode))

    run.__name__ = f"umi_correct_{mode}"
    return query()(run)


for _mode in (1, 2, 3):
    _corrected(_mode)


@query()
def umi_dedup_stat(spark, d):
    return umi.dedup_statistics(umi.corrected_pairs(_pairs(spark, d), 1), None, frame(spark, d, "v_umi"))


# --- fragments ----------------------------------------------------------------------------


@query(
    sql("v_ends") + ", g AS (SELECT rname, qname, count(*) AS n, max(CASE WHEN NOT reverse THEN coordinate END) AS s, max(CASE WHEN reverse THEN coordinate END) AS e, min_by(barcode, CASE WHEN barcode IS NOT NULL THEN ord END) AS barcode FROM v_ends GROUP BY 1, 2)"
    + " SELECT rname AS chrom, CAST(s AS INT) AS start, CAST(e AS INT) AS stop, barcode FROM g WHERE n = 2 AND barcode IS NOT NULL AND e - s BETWEEN 10 AND 5000"
)
def fragment_pairs(spark, d):
    return fragments.paired(frame(spark, d, "v_ends")).withColumnRenamed("end", "stop")


_COL = lambda src, by, out: f", {out} AS (SELECT chrom, start, stop, barcode, CAST(total AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, concat_ws('|', chrom, start, stop, barcode)) AS k FROM {src}) WHERE k = 1)"


@query(
    sql("v_collapse") + ", c0 AS (SELECT chrom, start, stop, barcode, count(*) AS n FROM v_collapse GROUP BY 1, 2, 3, 4)"
    + _COL("c0", "chrom, start, barcode", "c1") + _COL("c1", "chrom, stop, barcode", "c2") + _COL("c2", "chrom, start, stop", "c3") + " SELECT chrom, start, stop, barcode, n FROM c3"
)
def fragment_collapse(spark, d):
    return fragments.collapsed(frame(spark, d, "v_collapse")).withColumnRenamed("end", "stop").withColumnRenamed("count", "n")


@query(sql("v_reads") + " SELECT read_id, row_number() OVER (PARTITION BY rname, pos, flag & 16 ORDER BY length(umi) DESC, read_id) > 1 AS duplicate FROM v_reads WHERE flag & 4 = 0")
def mark_duplicates(spark, d):
    rows = frame(spark, d, "v_reads").where(~demux.unaligned()).withColumn("strand", F.col("flag").bitwiseAND(16))
    return fragments.mark_duplicates(rows, ["rname", "pos", "strand"], [F.length("umi").desc(), "read_id"]).select("read_id", "duplicate")


# --- matrices and quality -----------------------------------------------------------------

_UC = _PAIRS + ", uc AS (SELECT gene_id AS feature, cell_id AS barcode, count(*) AS n FROM pc GROUP BY 1, 2)"


def _umi_matrix(spark: SparkSession, d: str) -> DataFrame:
    return umi.gene_counts(umi.corrected_pairs(_pairs(spark, d), 0)).select(F.col("gene_id").alias("feature"), F.col("cell_id").alias("barcode"), "n")


@query(sql("v_umi") + _UC + " SELECT feature, barcode, round(ln(1 + n / sum(n) OVER (PARTITION BY barcode) * (SELECT count(DISTINCT barcode) FROM uc) / sum(n) OVER (PARTITION BY feature) * 10000), 6) AS value FROM uc")
def tfidf(spark, d):
    return rounded(matrix.tf_idf(_umi_matrix(spark, d)), "value")


@query(sql("v_umi") + _UC + " SELECT feature, barcode, round(n * 1000000.0 / sum(n) OVER (PARTITION BY barcode), 6) AS value FROM uc")
def counts_per_million(spark, d):
    return rounded(matrix.counts_per_million(_umi_matrix(spark, d)), "value")


@query(sql("v_umi") + _UC + ", t AS (SELECT barcode, sum(n) AS t FROM uc GROUP BY 1) SELECT feature, uc.barcode, round(log2(n * (SELECT avg(t) FROM t) / t.t + 1), 6) AS value FROM uc JOIN t ON t.barcode = uc.barcode")
def log_normalised(spark, d):
    return rounded(matrix.log_normalised(_umi_matrix(spark, d)), "value")


@query(sql("v_umi") + _UC + ", k AS (SELECT CAST(count(DISTINCT barcode) AS DOUBLE) AS k FROM uc), v AS (SELECT feature, sum(n) AS s, sum(n * n) AS q FROM uc GROUP BY 1) SELECT feature, round(s / k, 6) AS mean, round((q - s * s / k) / (k - 1), 6) AS variance FROM v, k")
def feature_variance(spark, d):
    return rounded(matrix.feature_variance(_umi_matrix(spark, d).withColumn("value", F.col("n").cast("double"))), "mean", "variance")


@query(sql("v_umi") + _UC + ", k AS (SELECT feature FROM uc GROUP BY 1 HAVING avg(n) > 1.1 AND count(*) > 5) SELECT feature, barcode, n FROM uc WHERE feature IN (SELECT feature FROM k)")
def abundant_features(spark, d):
    return matrix.abundant_features(_umi_matrix(spark, d)).select("feature", "barcode", "n")


_GENES = ", gc AS (SELECT gene_id, cell_bc AS cell_id, count(*) AS n FROM v_reads WHERE gene_id IS NOT NULL GROUP BY 1, 2)"
_MITO = [f"ENSG{i}" for i in (1, 2, 3)]


def _gene_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "v_reads").where("gene_id is not null")
    return rows.groupBy("gene_id", F.col("cell_bc").alias("cell_id")).agg(F.count("*").alias("n"))


@query(
    sql("v_reads") + _GENES
    + " SELECT cell_id, count(*) AS number_of_genes, CAST(sum(n) AS BIGINT) AS total_count_per_cell, round(sum(CASE WHEN starts_with(gene_id, 'ERCC-') THEN 0 ELSE n END) / (sum(n) + 1e-5), 6) AS \"non_ERCC_percent\","
    + f" round((sum(n) - sum(CASE WHEN gene_id IN ({', '.join(repr(g) for g in _MITO)}) THEN n ELSE 0 END)) / (sum(n) + 1e-5), 6) AS non_mt_percent FROM gc GROUP BY 1"
)
def gene_qc_metrics(spark, d):
    mito = spark.createDataFrame([(g,) for g in _MITO], "gene_id string")
    return rounded(qc.gene_metrics(_gene_counts(spark, d), mito), "non_ERCC_percent", "non_mt_percent")


@query(sql("v_reads") + " SELECT CASE WHEN count_if(starts_with(g, 'ENSG')) > count(*) / 2 THEN 'hsapiens_gene_ensembl' WHEN count_if(starts_with(g, 'ENSMUSG')) > count(*) / 2 THEN 'mmusculus_gene_ensembl' END AS organism, CASE WHEN greatest(count_if(starts_with(g, 'ENSG')), count_if(starts_with(g, 'ENSMUSG'))) > count(*) / 2 THEN 'ensembl_gene_id' END AS gene_id_type FROM (SELECT DISTINCT gene_id AS g FROM v_reads WHERE gene_id IS NOT NULL)")
def organism_guess(spark, d):
    return qc.guess_organism(frame(spark, d, "v_reads").where("gene_id is not null"))


@query()
def outliers_mahalanobis(spark, d):
    return qc.detect_outliers(qc.gene_metrics(_gene_counts(spark, d)), columns=["number_of_genes", "total_count_per_cell", "non_ERCC_percent"], side="both")


@query()
def empty_droplets(spark, d):
    return rounded(qc.empty_droplets(_counts(spark, d), lower=50), "log_probability", "p_value", "fdr")


@query()
def lsi_scores(spark, d):
    scores = matrix.lsi(matrix.tf_idf(_umi_matrix(spark, d)))
    return scores.select("barcode", F.transform("scores", lambda x: F.round(x, 4)).alias("scores"))


@query()
def knn_cells(spark, d):
    return rounded(matrix.nearest_cells(matrix.lsi(matrix.tf_idf(_umi_matrix(spark, d)))), "distance")


@query()
def cell_clusters(spark, d):
    return matrix.clusters(matrix.nearest_cells(matrix.lsi(matrix.tf_idf(_umi_matrix(spark, d)))))


_TYPES = ("unaligned", "aligned_unmapped", "ambiguous_mapping", "mapped_to_intron", "mapped_to_exon")
_CELL = ", cs AS (SELECT cell_bc AS cell_id, count_if(flag & 4 <> 0) AS unaligned, count_if(flag & 4 = 0 AND gene_id IS NULL AND map_status NOT IN (1, 2)) AS aligned_unmapped, count_if(flag & 4 = 0 AND gene_id IS NULL AND map_status = 1) AS ambiguous_mapping, count_if(flag & 4 = 0 AND gene_id IS NULL AND map_status = 2) AS mapped_to_intron, count_if(flag & 4 = 0 AND gene_id IS NOT NULL) AS mapped_to_exon FROM v_reads GROUP BY 1), pl AS (SELECT *, rank() OVER (ORDER BY mapped_to_exon DESC, cell_id) AS place, unaligned + aligned_unmapped + ambiguous_mapping + mapped_to_intron + mapped_to_exon AS total FROM cs)"


@query(sql("v_reads") + _CELL + " " + " UNION ALL ".join(f"SELECT cell_id, CAST(place AS INT) AS place, '{t}' AS type, round({t} / total, 6) AS value FROM pl" for t in _TYPES))
def plot_mapping_long(spark, d):
    rows = frame(spark, d, "v_reads").withColumn("cell_id", F.col("cell_bc"))
    stats = demux.cell_statistics(rows, rows.select("cell_id").distinct(), mito="none", spike_in="none")
    return rounded(qc.mapping_long(stats, columns=_TYPES, share=True), "value")


@query(
    sql("v_reads", "v_cells") + _ASSIGNED
    + ", y AS (SELECT CASE WHEN cell_id IS NOT NULL THEN 'barcode_match' WHEN flag & 4 <> 0 THEN 'barcode_unmatch_unaligned' WHEN gene_id IS NOT NULL THEN 'barcode_unmatch_mapped_to_exon' WHEN map_status = 1 THEN 'barcode_unmatch_ambiguous_mapping' WHEN map_status = 2 THEN 'barcode_unmatch_mapped_to_intron' ELSE 'barcode_unmatch_aligned' END AS status FROM x)"
    + ", s(status) AS (VALUES " + ", ".join(f"('{s}')" for s in demux.STATUSES) + "), c AS (SELECT s.status, count(y.status) AS n FROM s LEFT JOIN y ON s.status = y.status GROUP BY 1) SELECT status, n AS \"count\", round(n / sum(n) OVER (), 6) AS share FROM c"
)
def plot_demultiplex_share(spark, d):
    return rounded(qc.demultiplex_shares(demux.overall_statistics(_assigned(spark, d))), "share")


_STATS = ", st AS (SELECT barcode AS cell, CAST(sum(n) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS f FROM counts GROUP BY 1)"


@query(sql("v_frag", "v_feat") + _COUNTS + _STATS + " SELECT round(regr_intercept(ln(f + 1), ln(c + 1)), 6) AS intercept, round(regr_slope(ln(f + 1), ln(c + 1)), 6) AS slope, round(corr(ln(c + 1), ln(f + 1)), 6) AS correlation FROM st")
def plot_counts_against_features(spark, d):
    return rounded(qc.fitted_line(features.stats_per_cell(_counts(spark, d)), "counts_per_cell", "features_per_cell"), "intercept", "slope", "correlation")


@query(sql("v_frag", "v_feat") + _COUNTS + _STATS + ", o AS (SELECT cell, f, row_number() OVER (ORDER BY f, cell) AS place FROM st) SELECT cell, CAST(f AS BIGINT) AS features_per_cell, CAST(place AS INT) AS place FROM o")
def plot_features_ordered(spark, d):
    return qc.ordered_features(features.stats_per_cell(_counts(spark, d))).select("cell", "features_per_cell", "place")


@query(
    sql("v_frag", "v_feat") + _COUNTS + ", st AS (SELECT feature, CAST(sum(n) AS DOUBLE) AS v FROM counts GROUP BY 1), e AS (SELECT min(v) AS lo, max(v) AS hi FROM st), b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, lo, hi FROM st, e) SELECT bin, round(min(lo + bin * (hi - lo) / 10), 6) AS low, count(*) AS n FROM b GROUP BY 1"
)
def plot_counts_histogram(spark, d):
    return rounded(qc.histogram(features.stats_per_feature(_counts(spark, d)), "counts_per_feature"), "low")


@query(sql("v_reads") + _GENES + ", m AS (SELECT cell_id, CAST(count(*) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS t FROM gc GROUP BY 1) SELECT 'number_of_genes' AS a, 'total_count_per_cell' AS b, round(corr(g, t), 6) AS correlation FROM m")
def qc_correlations(spark, d):
    return rounded(qc.correlations(qc.gene_metrics(_gene_counts(spark, d)), ["number_of_genes", "total_count_per_cell"]), "correlation")


# --- integration --------------------------------------------------------------------------

_MERGE = f"WITH a AS (SELECT {base4('c_custkey', 6)} AS rna, c_nationkey AS rna_q, concat('k', c_custkey % 450) AS key FROM customer), b AS (SELECT {base4('s_suppkey', 5)} AS atac, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS atac_q, concat('k', s_suppkey % 300 * 3) AS key FROM supplier), m AS (SELECT a.rna, a.rna_q, b.atac, b.atac_q, coalesce(a.key, b.key) AS key FROM a FULL JOIN b ON a.key = b.key)"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    a = spark.read.parquet(f"{d}/customer.parquet").selectExpr(f"{base4('c_custkey', 6)} as rna", "c_nationkey as rna_q", "concat('k', c_custkey % 450) as key")
    b = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(f"{base4('s_suppkey', 5)} as atac", "case when s_suppkey % 7 = 0 then null else s_nationkey end as atac_q", "concat('k', s_suppkey % 300 * 3) as key")
    return experiment.outer_merge([a, b])


@query(_MERGE + " SELECT key, rna, rna_q, atac, atac_q FROM m")
def integrate_outer_merge(spark, d):
    return _merged(spark, d).select("key", "rna", "rna_q", "atac", "atac_q")


@query(_MERGE + " SELECT DISTINCT rna FROM m WHERE rna IS NOT NULL AND rna_q IS NOT NULL AND atac IS NOT NULL AND atac_q IS NOT NULL AND key IS NOT NULL")
def shared_barcodes(spark, d):
    return _merged(spark, d).dropna().select("rna").distinct()


@query(
    "WITH f AS (SELECT concat('g', p_partkey) AS gene_id FROM part), m AS (SELECT concat('g', p_partkey) AS old_id, min(CASE WHEN p_partkey % 5 <> 0 THEN concat('n', p_partkey % 1500) END) AS new_id FROM (SELECT p_partkey * CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS p_partkey FROM part) GROUP BY 1), j AS (SELECT f.gene_id, m.new_id AS x, count(m.new_id) OVER (PARTITION BY m.new_id) AS k FROM f LEFT JOIN m ON m.old_id = f.gene_id) SELECT gene_id, CASE WHEN x IS NULL OR k > 1 THEN gene_id ELSE x END AS new_id FROM j"
)
def convert_gene_ids(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    # a third of the ids is not in the mapping, which has others instead
    table = part.selectExpr("p_partkey * case when p_partkey % 3 = 0 then -1 else 1 end as p_partkey").selectExpr("concat('g', p_partkey) as old_id", "case when p_partkey % 5 <> 0 then concat('n', p_partkey % 1500) end as new_id")
    return convert_ids(part.selectExpr("concat('g', p_partkey) as gene_id"), table)


from . import containers, files, steps, streams  # noqa: E402, F401
