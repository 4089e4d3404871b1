"""Queries of single steps: functions, filters, joins and tallies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import annotation, demux, experiment, features, fragments, mapping, matrix, qc, reads, umi
from ..operators import barcodes as bc
from .assay import frame, sql
from .catalog import query, rounded
from .registry import _ASSIGNED, _GENES, _HIST, _INLINE, _PAIRS, _UC, _VALID, _assigned, _gene_counts, _inline, _pairs, _umi_matrix


def table(spark, d, name, *expressions):
    return spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*expressions)


# --- strings ------------------------------------------------------------------------------

_CODES = "translate(substr(seq1, 1, 8), 'ACGTN', 'RMKSB')"


@query(sql("v_pairs") + f" SELECT ordinal, {_CODES} AS codes, reverse(translate({_CODES}, 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')) AS rc FROM v_pairs")
def iupac_complement(spark, d):
    rows = frame(spark, d, "v_pairs").selectExpr("ordinal", f"{_CODES} as codes")
    return rows.select("ordinal", "codes", sq.reverse_complement_iupac("codes").alias("rc"))


@query(sql("v_frag") + " SELECT chrom, start, stop, barcode, CAST(CASE WHEN stop < 30000 THEN -1 WHEN start > 32000 THEN 1 ELSE 0 END AS INT) AS place FROM v_frag")
def interval_positions(spark, d):
    rows = frame(spark, d, "v_frag")
    return rows.select("chrom", "start", F.col("end").alias("stop"), "barcode", sq.interval_position("start", "end", F.lit(30000), F.lit(32000)).alias("place"))


_STRAND = "CASE o_orderkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END"


@query(f"SELECT o_orderkey, {_STRAND} AS symbol, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS INT) AS sign FROM orders")
def strand_signs(spark, d):
    return table(spark, d, "orders", "o_orderkey", f"{_STRAND} as symbol").withColumn("sign", sq.strand_sign("symbol"))


_NAME = "CASE o_orderkey % 5 WHEN 0 THEN 'MT' WHEN 1 THEN CAST(o_custkey % 22 + 1 AS VARCHAR(20)) WHEN 2 THEN 'chr9' WHEN 3 THEN 'GL000194' ELSE 'X' END"


@query(f"WITH n AS (SELECT o_orderkey, {_NAME} AS name FROM orders) SELECT o_orderkey, CASE WHEN name = 'MT' THEN 'chrM' WHEN length(name) > 4 OR starts_with(name, 'chr') THEN name ELSE concat('chr', name) END AS fixed, concat('chr', name) AS prefixed FROM n")
def fixed_chromosomes(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", f"{_NAME.replace('VARCHAR(20)', 'string')} as name")
    return rows.select("o_orderkey", sq.fix_chromosome("name").alias("fixed"), sq.chr_prefixed("name").alias("prefixed"))


@query(sql("v_frag") + " SELECT concat(chrom, '|', start, '|', stop, '|', barcode) AS key, chrom, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, barcode FROM v_frag")
def fragment_keys(spark, d):
    keys = frame(spark, d, "v_frag").select(sq.fragment_key("chrom", "start", "end", "barcode").alias("key"))
    return keys.select("key", sq.parse_fragment_key("key").alias("p")).select("key", "p.chrom", "p.start", F.col("p.end").alias("stop"), "p.barcode")


@query(sql("v_collapse") + ", k AS (SELECT DISTINCT concat(chrom, '|', start, '|', stop, '|', barcode) AS key FROM v_collapse) SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM k")
def fragment_ids(spark, d):
    return fragments.fragment_ids(frame(spark, d, "v_collapse"))


@query("SELECT * FROM (VALUES ('CEL-Seq', -1, 0, 6, 8, 0, 6), ('celseq2', -1, 0, 6, 8, 0, 6), ('Drop-seq', -1, 0, 0, 12, 12, 8), ('10X', -1, 0, 0, 16, 16, 10), ('Chromium V1', -1, 0, 0, 16, 16, 10)) t(protocol, bs1, bl1, bs2, bl2, us, ul)")
def read_structures(spark, d):
    made = [(name, sq.read_structure(name)) for name in ("CEL-Seq", "celseq2", "Drop-seq", "10X", "Chromium V1")]
    return spark.createDataFrame([(n, s.bs1, s.bl1, s.bs2, s.bl2, s.us, s.ul) for n, s in made], "protocol string, bs1 int, bl1 int, bs2 int, bl2 int, us int, ul int")


@query(sql("v_exon") + " SELECT gene_id, EXISTS (SELECT 1 FROM v_exon x WHERE x.gene_id = e.gene_id AND x.start <= g + 160 AND x.stop >= g + 130) AS inside FROM (SELECT gene_id, min(start) AS g FROM v_exon GROUP BY 1) e")
def exon_hits(spark, d):
    genes = frame(spark, d, "v_exon").groupBy("gene_id").agg(F.min("start").alias("g"), F.collect_list(F.struct("start", "end")).alias("exons"))
    return genes.select("gene_id", mapping.in_exon("exons", F.col("g") + 130, F.col("g") + 160).alias("inside"))


# --- reads --------------------------------------------------------------------------------

_SKIP = sq.FilterSettings(rmlow=False, rmN=False)
_LAYOUTS = {
    "second": (sq.ReadStructure(-1, 0, 6, 8, 0, 6), "concat(substr(seq2, 7, 8), '_', substr(seq2, 1, 6), '#', name)", "seq1"),
    "second, no UMI": (sq.ReadStructure(-1, 0, 0, 8, -1, 0), "concat(substr(seq2, 1, 8), '_#', name)", "seq1"),
    "both, no UMI": (sq.ReadStructure(0, 2, 0, 8, -1, 0), "concat(substr(seq1, 1, 2), substr(seq2, 1, 8), '_#', name)", "substr(seq1, 3)"),
}


@query(sql("v_pairs") + " " + " UNION ALL ".join(f"SELECT '{k}' AS layout, ordinal, {name} AS name, {seq} AS seq FROM v_pairs" for k, (_, name, seq) in _LAYOUTS.items()))
def trim_layouts(spark, d):
    parts = [reads.trim_paired(frame(spark, d, "v_pairs"), s, _SKIP).select(F.lit(k).alias("layout"), "ordinal", "name", "seq") for k, (s, _, _) in _LAYOUTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql("v_pairs") + " SELECT ordinal FROM v_pairs WHERE ordinal % 5 >= 4")
def short_pairs_skipped(spark, d):
    cut = lambda c: F.expr(f"substring({c}, 1, cast(10 + ordinal % 5 as int))").alias(c)
    pairs = frame(spark, d, "v_pairs").select("ordinal", "name", "seq1", "qual1", cut("seq2"), cut("qual2"))
    return reads.trim_paired(pairs, sq.ReadStructure(-1, 0, 6, 8, 0, 6), _SKIP).select("ordinal")


_LOW6 = "length(regexp_replace(substr(qual2, 1, 6), '[^#5]', '', 'g')) > 2"


@query(sql("v_pairs") + f" SELECT ordinal, CASE WHEN {_LOW6} THEN 'low_quality' WHEN contains(substr(seq2, 1, 6), 'N') THEN 'has_n' ELSE 'pass' END AS status, concat(substr(seq1, 1, 6), '#', substr(seq2, 1, 6), '#', name) AS name FROM v_pairs WHERE NOT contains(substr(seq1, 1, 6), 'N') AND length(regexp_replace(substr(qual1, 1, 6), '[^#5]', '', 'g')) <= 2")
def barcode_read_filters(spark, d):
    clean = "not contains(substr(seq1, 1, 6), 'N') and length(regexp_replace(substr(qual1, 1, 6), '[^#5]', '')) <= 2"
    return reads.with_barcode_reads(_triples(spark, d).where(clean), rmN=True, rmlow=True).select("ordinal", "status", "name")


def _triples(spark, d):
    one = lambda m: F.struct(F.substring(f"seq{m}", 1, 6).alias("seq"), F.substring(f"qual{m}", 1, 6).alias("qual"))
    return frame(spark, d, "v_pairs").withColumn("barcodes", F.array(one(2), one(1)))


#: Matches of the first six letters of both mates, the best by quality, as (seen, bq, barcode, position).
_BY_QUALITY = (
    _VALID
    + ", u AS (SELECT DISTINCT substr(seq2, 1, 6) AS seen, substr(qual2, 1, 6) AS bq FROM v_pairs WHERE NOT contains(substr(seq2, 1, 6), 'N') UNION SELECT DISTINCT substr(seq1, 1, 6), substr(qual1, 1, 6) FROM v_pairs WHERE NOT contains(substr(seq1, 1, 6), 'N'))"
    + ", x AS (SELECT seen, bq, max(k) AS d FROM u, generate_series(0, 6) g(k) WHERE EXISTS (SELECT 1 FROM w WHERE substr(w.barcode, 1, k) = substr(u.seen, 1, k)) GROUP BY 1, 2)"
    + ", h AS (SELECT DISTINCT seen, bq, barcode, CAST(CASE WHEN d = 6 THEN -1 ELSE d END AS INT) AS position FROM x JOIN w ON (d = 6 AND barcode = seen) OR (d < 6 AND substr(barcode, 1, d) = substr(seen, 1, d) AND substr(barcode, d + 2) = substr(seen, d + 2)))"
    + ", m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY seen, bq ORDER BY CASE WHEN position < 0 THEN 1048576 ELSE ascii(substr(bq, position + 1, 1)) END DESC, barcode) = 1)"
)


@query(sql("v_pairs", "v_cells") + _BY_QUALITY + " SELECT seen, bq, barcode, position FROM m")
def prefix_mismatch_by_quality(spark, d):
    part = lambda m: frame(spark, d, "v_pairs").select(F.substring(f"seq{m}", 1, 6).alias("seen"), F.substring(f"qual{m}", 1, 6).alias("bq"))
    seen = part(1).unionByName(part(2)).where("not contains(seen, 'N')")
    return bc.prefix_match(seen, frame(spark, d, "v_cells"), quality="bq").select("seen", "bq", "barcode", "position")


_MATCHED = (
    _BY_QUALITY
    + ", r AS (SELECT ordinal, concat(coalesce(b.barcode, substr(seq1, 1, 6)), '#', coalesce(a.barcode, substr(seq2, 1, 6)), '#', name) AS name,"
    + " CASE WHEN a.position = -1 AND b.position = -1 THEN 'exact' WHEN a.position IS NULL AND b.position IS NULL THEN 'none' ELSE 'partial' END AS match_type"
    + " FROM v_pairs LEFT JOIN m a ON a.seen = substr(seq2, 1, 6) AND a.bq = substr(qual2, 1, 6) LEFT JOIN m b ON b.seen = substr(seq1, 1, 6) AND b.bq = substr(qual1, 1, 6) WHERE NOT contains(substr(seq1, 1, 6), 'N') AND NOT contains(substr(seq2, 1, 6), 'N'))"
)


def _matched(spark, d):
    plain = _triples(spark, d).where("not contains(substr(seq1, 1, 6), 'N') and not contains(substr(seq2, 1, 6), 'N')")
    return reads.with_barcode_reads(plain, valid=frame(spark, d, "v_cells"))


@query(sql("v_pairs", "v_cells") + _MATCHED + " SELECT ordinal, name, match_type FROM r")
def barcode_read_matches(spark, d):
    return _matched(spark, d).select("ordinal", "name", "match_type")


@query(sql("v_pairs", "v_cells") + _MATCHED + " SELECT count(*) AS total, count_if(match_type = 'exact') AS exact_match, count_if(match_type = 'partial') AS partial_match, count_if(match_type = 'none') AS none_match, count(DISTINCT substr(name, 1, 6)) AS barcodes_seen FROM r")
def barcode_read_summary(spark, d):
    return reads.match_summary(_matched(spark, d)).select("total", "exact_match", "partial_match", "none_match", "barcodes_seen")


@query(sql("v_pairs", "v_cells") + _INLINE + " SELECT match_type, 2 * count(*) AS \"count\" FROM t WHERE status = 'pass' GROUP BY 1")
def match_type_mates(spark, d):
    return demux.match_type_statistics(_inline(spark, d))


@query(sql("v_reads", "v_cells") + _HIST + ", k AS (SELECT barcode, n FROM h WHERE n >= 3), p AS (SELECT k.barcode AS seen, c.barcode, hamming(k.barcode, c.barcode) AS d, k.n FROM k, (SELECT DISTINCT barcode FROM v_cells) c WHERE hamming(k.barcode, c.barcode) <= 1 QUALIFY row_number() OVER (PARTITION BY seen ORDER BY d, c.barcode) = 1), s AS (SELECT barcode, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, barcode DESC) AS r FROM s QUALIFY r <= 20) SELECT concat('CELL_', lpad(CAST(r AS VARCHAR), CAST(length(CAST((SELECT count(*) FROM t) AS VARCHAR)) + 1 AS INT), '0')) AS cell_name, barcode AS barcode_sequence, n AS \"count\" FROM t")
def detected_barcodes(spark, d):
    named = frame(spark, d, "v_reads").select(F.concat("cell_bc", "qname").alias("name"), F.col("read_id").alias("ordinal"))
    return bc.detect(named, 6, frame(spark, d, "v_cells"), max_reads=0, min_count=3, cells=20)


@query(sql("v_pairs", "v_cells") + _MATCHED + " SELECT ordinal, name, match_type FROM r")
def barcode_window_matches(spark, d):
    rows = _triples(spark, d).where("not contains(substr(seq1, 1, 6), 'N') and not contains(substr(seq2, 1, 6), 'N')")
    pad = lambda b: F.struct(F.concat(F.lit("NNN"), b["seq"], F.lit("NN")).alias("seq"), F.concat(F.lit("###"), b["qual"], F.lit("##")).alias("qual"))
    wider = rows.withColumn("barcodes", F.transform("barcodes", pad))
    return reads.with_barcode_reads(wider, valid=frame(spark, d, "v_cells"), window=(3, 6)).select("ordinal", "name", "match_type")


# --- demultiplexing -----------------------------------------------------------------------


@query(sql("v_reads", "v_cells") + _ASSIGNED + " SELECT read_id, c.barcode AS cell_bc FROM x JOIN v_cells c ON c.cell_id = x.cell_id WHERE flag & 4 = 0")
def corrected_barcodes(spark, d):
    return demux.corrected(_assigned(spark, d)).select("read_id", "cell_bc")


_CLASSES = " ".join(f"WHEN flag IN ({', '.join(map(str, fs))}) THEN 'nomatch_{n}'" for n, fs in demux.FLAG_CLASSES.items())


@query(f"WITH f AS (SELECT event_id, CAST(event_id % 190 AS INT) AS flag FROM events) SELECT event_id, CASE {_CLASSES} END AS type FROM f")
def flag_classes_prefixed(spark, d):
    return table(spark, d, "events", "event_id", "cast(event_id % 190 as int) as flag").select("event_id", demux.flag_class("flag", "nomatch_").alias("type"))


@query(sql("v_reads") + " SELECT DISTINCT rname FROM v_reads WHERE flag & 4 = 0")
def contig_names(spark, d):
    return demux.contigs(frame(spark, d, "v_reads"))


_FAR = "concat('chr', cast(user_id % 11 + 1 as varchar(20)))"


@query(sql("v_exon") + f" SELECT DISTINCT {_FAR} AS chrom FROM events WHERE {_FAR} NOT IN (SELECT chrom FROM v_exon)")
def chromosomes_missing(spark, d):
    return annotation.missing_chromosomes(table(spark, d, "events", f"{_FAR.replace('varchar(20)', 'string')} as rname"), frame(spark, d, "v_exon"))


@query("SELECT DISTINCT concat('g', o_custkey) AS gene_id FROM orders WHERE o_orderkey % 100 IN (3, 42)")
def genes_of_terms(spark, d):
    return annotation.genes_of_terms(table(spark, d, "orders", "concat('GO:', o_orderkey % 100) as go_id", "concat('g', o_custkey) as gene_id"), ["GO:3", "GO:42"])


# --- fragments ----------------------------------------------------------------------------

_MAPQ = "CAST(20 + length(cigar) AS INT)"


@query(
    sql("v_aligned") + f", a AS (SELECT *, {_MAPQ} AS mapq, CAST(regexp_extract(cigar, '^([0-9]+)M', 1) AS INT) + CAST(regexp_extract(cigar, 'M([0-9]+)N', 1) AS INT) + 30 AS span FROM v_aligned)"
    " SELECT CAST(pos AS BIGINT) AS ord, rname, qname, CAST(CASE WHEN flag & 16 <> 0 THEN pos + span - 5 ELSE pos + 4 END AS INT) AS coordinate, flag & 16 <> 0 AS reverse, regexp_extract(qname, '^[0-9]+') AS barcode FROM a WHERE mapq >= 30 AND rname <> 'chr7'"
)
def eligible_fragment_ends(spark, d):
    rows = frame(spark, d, "v_aligned").withColumn("mapq", F.expr(_MAPQ))
    return fragments.eligible_ends(rows, 30, "^chr[1-6]$", name_pattern="^[0-9]+")


_SITES = "SELECT tss_id, chrom, start - 200 AS start, stop + 200 AS stop, start - 900 AS left_start, start - 500 AS left_stop FROM v_tss"


@query(
    sql("v_tss", "v_frag") + f", s AS ({_SITES}), o AS (SELECT tss_id, count(*) AS n FROM s JOIN v_frag f ON f.chrom = s.chrom AND f.start <= s.stop + 1 AND f.stop + 1 >= s.start GROUP BY 1), l AS (SELECT tss_id, count(*) AS n FROM s JOIN v_frag f ON f.chrom = s.chrom AND f.start <= left_stop + 1 AND f.stop + 1 >= left_start GROUP BY 1)"
    " SELECT s.tss_id, round((coalesce(o.n, 0) + 1) / (coalesce(l.n, 0) + 1), 6) AS enrichment FROM s LEFT JOIN o ON o.tss_id = s.tss_id LEFT JOIN l ON l.tss_id = s.tss_id"
)
def start_site_ratios(spark, d):
    sites = frame(spark, d, "v_tss").selectExpr("tss_id", "chrom", "start - 200 as start", "end + 200 as end", "start - 900 as left_start", "start - 500 as left_end")
    return rounded(features.start_site_enrichment(sites, frame(spark, d, "v_frag"), "tss_id"), "enrichment")


_SCORE = "20 * length(regexp_replace(qual1, '[^5]', '', 'g')) + 30 * length(regexp_replace(qual1, '[^?]', '', 'g')) + 40 * length(regexp_replace(qual1, '[^I]', '', 'g'))"


@query(sql("v_pairs") + f", s AS (SELECT name, ordinal % 400 AS pos, {_SCORE} AS score FROM v_pairs) SELECT name AS qname, CAST(pos AS BIGINT) AS pos FROM s QUALIFY row_number() OVER (PARTITION BY pos ORDER BY score DESC, name) = 1")
def duplicates_by_quality(spark, d):
    rows = frame(spark, d, "v_pairs").select(F.col("name").alias("qname"), (F.col("ordinal") % 400).alias("pos"), F.col("qual1").alias("qual"))
    return fragments.best_molecules(rows, ["pos"]).select("qname", "pos")


# --- molecules, cells and features --------------------------------------------------------

_FEW = ", pl AS (SELECT cell_id, gene_id FROM pc GROUP BY 1, 2 HAVING sum(n) > 1), kept AS (SELECT pc.* FROM pc JOIN pl ON pl.cell_id = pc.cell_id AND pl.gene_id = pc.gene_id)"


def _counted(spark, d):
    rows = frame(spark, d, "v_umi").select("cell_id", "gene_id", F.col("umi").alias("UMI"), F.col("pos").alias("position"))
    return umi.count_genes(rows, frame(spark, d, "v_umi").select("cell_id").distinct(), mode=0, gene_filter=True)


@query(sql("v_umi") + _PAIRS + _FEW + " SELECT gene_id, cell_id, count(*) AS n FROM kept GROUP BY 1, 2")
def gene_counts_filtered(spark, d):
    return _counted(spark, d)["counts"]


@query(
    sql("v_umi") + _PAIRS + ", g AS (SELECT cell_id, count(*) AS k FROM (SELECT cell_id, gene_id FROM pc GROUP BY 1, 2 HAVING sum(n) = 1) GROUP BY 1)"
    ' SELECT c.cell_id, coalesce(k, 0) AS filtered_gene, CAST(0 AS BIGINT) AS "corrected_UMI", 0.0 AS "A_prop", 0.0 AS "T_prop", 0.0 AS "G_prop", 0.0 AS "C_prop" FROM (SELECT DISTINCT cell_id FROM v_umi) c LEFT JOIN g ON g.cell_id = c.cell_id'
)
def dedup_statistics_filtered(spark, d):
    return _counted(spark, d)["statistics"]


_LINES = [str(k) for k in range(1, 8)]


@query(sql("v_umi") + ", p AS (SELECT DISTINCT gene_id, pos, cell_id, umi FROM v_umi) SELECT gene_id, " + ", ".join(f'count_if(pos = {k}) AS "line{k}"' for k in _LINES) + " FROM p GROUP BY 1")
def gene_cell_matrix(spark, d):
    rows = frame(spark, d, "v_umi").select("gene_id", F.concat(F.lit("line"), "pos").alias("cell_id"), "umi", F.col("cell_id").alias("lane")).distinct()
    counts = rows.groupBy("gene_id", "cell_id").agg(F.count("*").alias("n"))
    return umi.count_matrix(counts, [f"line{k}" for k in _LINES])


@query(sql("v_umi") + _UC + ", t AS (SELECT barcode, CAST(sum(n) AS BIGINT) AS total FROM uc GROUP BY 1), k AS (SELECT total, count(*) AS n FROM t GROUP BY 1) SELECT total, n, round(coalesce(sum(n) OVER (ORDER BY total DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2, 6) AS rank FROM k")
def barcode_ranks(spark, d):
    totals = _umi_matrix(spark, d).groupBy("barcode").agg(F.sum("n").alias("total"))
    return rounded(features.size_ranks(totals), "rank")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat(c_custkey, ':1')), c_custkey LIMIT 50")
def random_subset(spark, d):
    return qc.sampled(table(spark, d, "customer", "c_custkey", "c_name"), 50, "c_custkey")


@query(sql("v_umi") + _UC + ", k AS (SELECT CAST(count(DISTINCT barcode) AS DOUBLE) AS k FROM uc), v AS (SELECT feature, sum(n) AS s, sum(n * n) AS q FROM uc GROUP BY 1), m AS (SELECT feature, s / k AS mean, (q - s * s / k) / (k - 1) AS variance FROM v, k) SELECT feature, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m ORDER BY m.variance DESC, feature LIMIT 60")
def variable_features(spark, d):
    values = _umi_matrix(spark, d).withColumn("value", F.col("n").cast("double"))
    return rounded(matrix.most_variable(values, 60), "mean", "variance")


@query(sql("v_reads") + _GENES + " SELECT cell_id, count(*) AS number_of_genes FROM gc GROUP BY 1 HAVING count(*) >= 3")
def outliers_removed(spark, d):
    cells = qc.gene_metrics(_gene_counts(spark, d)).withColumn("outliers", F.col("number_of_genes") < 3)
    return qc.remove_outliers(cells).select("cell_id", "number_of_genes")


_LAYOUT = "SELECT concat('c', c_custkey) AS barcode, round(c_acctbal, 6) AS x, CAST(c_nationkey AS DOUBLE) AS y, CAST(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 END AS INT) AS cluster, c_mktsegment AS segment FROM customer"


def _layout(spark, d):
    scores = table(spark, d, "customer", "concat('c', c_custkey) as barcode", "array(round(c_acctbal, 6), cast(c_nationkey as double), 1.0D) as scores")
    groups = table(spark, d, "customer", "concat('c', c_custkey) as barcode", "cast(c_custkey % 6 as int) as cluster", "c_custkey % 4 as k").where("k <> 0").drop("k")
    return matrix.layout(scores, groups, table(spark, d, "customer", "concat('c', c_custkey) as barcode", "c_mktsegment as segment"))


@query(_LAYOUT)
def layout_with_clusters(spark, d):
    return _layout(spark, d)


@query(f"WITH l AS ({_LAYOUT}) SELECT 'one' AS tech, barcode, x, y, cluster, segment FROM l UNION ALL SELECT 'two', barcode, x, y, cluster, NULL FROM l")
def layouts_stacked(spark, d):
    return experiment.stacked_layouts({"one": _layout(spark, d), "two": _layout(spark, d).drop("segment")})
