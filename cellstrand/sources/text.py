"""Annotation, region, barcode and result tables from text files, with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.annotation import attributes, to_saf, with_gene_ids

GFF_SUFFIXES = (".gff", ".gff3", ".gtf", ".gff.gz", ".gff3.gz", ".gtf.gz")


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of GFF, GFF3 or GTF files: the nine columns, and ``attr``, a map."""
    for p in _paths(path):
        if not p.lower().endswith(GFF_SUFFIXES):
            raise ValueError(f"not a gff, gff3 or gtf file: {p}")
    lines = spark.read.text(_paths(path)).where("length(value) > 0 and not startswith(value, '#')")
    c = F.split("value", "\t")
    get = lambda i: F.try_element_at(c, F.lit(i))
    number = lambda i: get(i).try_cast("int")
    rows = lines.select(
        get(1).alias("seqid"), get(2).alias("source"), get(3).alias("type"), number(4).alias("start"), number(5).alias("end"),
        get(6).alias("score"), get(7).alias("strand"), get(8).alias("phase"), get(9).alias("attributes"),
    )
    return rows.where("start is not null").withColumn("attr", attributes("attributes"))


def import_annotation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Exons of annotation files as (GeneID, Chr, Start, End, Strand)."""
    return to_saf(with_gene_ids(read_gff(spark, path)))


def annotation_source(spark: SparkSession, path: str) -> str:
    """ensembl, gencode or refseq, by what the first lines say; ensembl if nothing does."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(1000).collect()).lower()
    return "gencode" if "gencode" in head else "refseq" if "refseq" in head or "dbxref=geneid" in head else "ensembl"


def read_exon_bed(spark: SparkSession, path: str) -> DataFrame:
    """Five columns (id, chromosome, start, end, strand) with a header, as SAF."""
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.SAF, enforceSchema=True)


def read_saf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.SAF)


def read_regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """BED or narrowPeak as closed, 1-based (chrom, start, end)."""
    rows = read_bed3(spark, path)
    return rows.withColumn("start", F.col("start") + 1)


def read_bed3(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first three columns of a BED file, numbers as they are."""
    c = F.split("value", "\t")
    lines = spark.read.text(_paths(path)).where("length(value) > 0 and not value rlike '^(#|track|browser)'")
    at = lambda i: F.try_element_at(c, F.lit(i))
    return lines.select(at(1).alias("chrom"), at(2).try_cast("int").alias("start"), at(3).try_cast("int").alias("end")).where("end is not null")


def read_fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, start, end, barcode, count) without a header."""
    rows = spark.read.csv(_paths(path), sep="\t", schema=schemas.FRAGMENTS, mode="FAILFAST")
    return rows.withColumnRenamed("seqnames", "chrom")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, description, sequence), a row per record."""
    records = spark.read.text(_paths(path), lineSep=">").where("length(trim(value)) > 0")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return records.select(F.split(head, r"\s+")[0].alias("name"), head.alias("description"), body.alias("sequence"))


def fasta_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_fasta(spark, path).select(F.col("name").alias("chrom"), F.length("sequence").cast("long").alias("length"))


def read_chromosome_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns (name, length) of a sizes table or a FASTA index."""
    c = F.split("value", "\t")
    return spark.read.text(path).select(c[0].alias("chrom"), F.try_element_at(c, F.lit(2)).try_cast("long").alias("length")).where("length is not null")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, barcode, ord) of a table with a header, separated by commas or tabs;
    lines under three characters are left out."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where("length(value) >= 3")
    c = F.split("value", "[,\t]")
    rows = lines.select(F.trim(c[0]).alias("cell_id"), F.trim(F.try_element_at(c, F.lit(2))).alias("barcode"), F.col("ord"))
    return rows.where("ord > 0 and barcode is not null")


def read_valid_barcodes(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """Barcodes of a list: the second of comma-separated columns, or the whole line."""
    c = F.split("value", ",")
    code = F.coalesce(F.try_element_at(c, F.lit(2)), F.col("value"))
    return spark.read.text(path).select((F.trim(code) if trim else code).alias("barcode")).where("length(barcode) > 0")


def read_lines(spark: SparkSession, path: str, name: str = "barcode") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.length(name) > 0)


def cell_list(spark: SparkSession, cells: str | list[str], is_path: bool = False) -> DataFrame:
    """Cells from a file with one a line, a comma-separated text or a list."""
    if is_path:
        return read_lines(spark, cells)
    names = [c.strip() for c in cells.split(",")] if isinstance(cells, str) else list(cells)
    return spark.createDataFrame([(c,) for c in names if c], "barcode string")


def read_rna_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """counts (long), cell_stat, overall_stat and duplication of a counting run's folder."""
    csv = lambda name: spark.read.csv(f"{folder}/{name}", header=True, inferSchema=False)
    wide = csv("gene_count.csv")
    cells = [c for c in wide.columns if c != wide.columns[0]]
    counts = wide.select(F.col(wide.columns[0]).alias("gene_id"), *[F.col(f"`{c}`").cast("long").alias(c) for c in cells]).unpivot("gene_id", cells, "cell_id", "n")
    numbers = lambda df: df.select(df.columns[0], *[F.col(f"`{c}`").cast("long").alias(c.strip()) for c in df.columns[1:]])
    return {
        "counts": counts,
        "cell_stat": numbers(csv("stat/cell_stat.csv")),
        "overall_stat": numbers(csv("stat/overall_stat.csv")),
        "duplication": csv("stat/UMI_duplication_count.csv").select(*[F.col(f"`{c}`").cast("long").alias(n) for c, n in zip(csv("stat/UMI_duplication_count.csv").columns, ("duplication_number", "count"), strict=False)]),
    }


def ercc_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Exons of the spike-in annotation, whose place is an argument."""
    return import_annotation(spark, path)


def read_atac_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """counts, per_cell, per_feature, cell_qc and, if there, mapping_stats of an ATAC
    run's folder: the counts as Parquet, the others as CSV with a header."""
    csv = lambda name: spark.read.csv(f"{folder}/{name}", header=True)
    typed = lambda df, text: df.select(*[F.col(f"`{c}`") if c in text else F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns])
    flags = ("promoter_overlaps", "enhancer_overlaps", "tss_overlaps", "gene_overlaps", "intergenic", "cell_called")
    out = {
        "counts": spark.read.parquet(f"{folder}/counts"),
        "per_cell": typed(csv("per_cell"), ("cell",)),
        "per_feature": typed(csv("per_feature"), ("feature", *flags)),
        "cell_qc": typed(csv("cell_qc"), ("bc", *flags)),
    }
    try:
        out["mapping_stats"] = typed(csv("mapping_stats"), ("barcode",))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return out
