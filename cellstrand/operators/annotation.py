"""Gene annotation: GFF/GTF rows to exon tables, gene models, id conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import fix_chromosome, strand_sign
from .intervals import extent, flatten

SAF_COLUMNS = ("GeneID", "Chr", "Start", "End", "Strand")


def attributes(text: str = "attributes") -> Column:
    """A map of GFF3 (``key=value;``) or GTF (``key "value";``) attributes."""
    gff = F.regexp_extract_all(F.col(text), F.lit(r'\s*([^=;"\s]+)=([^;]*)'), 0)
    gtf = F.regexp_extract_all(F.col(text), F.lit(r'\s*([^=;"\s]+)\s+"([^"]*)"'), 0)
    pair = lambda pattern: lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.regexp_extract(x, pattern, 2).alias("value"))
    first = lambda entries: F.aggregate(
        entries,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))),
    )
    made = F.when(F.size(gtf) > 0, F.transform(gtf, pair(r'\s*([^=;"\s]+)\s+"([^"]*)"'))).otherwise(F.transform(gff, pair(r'\s*([^=;"\s]+)=([^;]*)')))
    return first(made)


def bare_id(c: Column) -> Column:
    """An id without its kind before a colon (``gene:X`` to ``X``)."""
    return F.when(F.instr(c, ":") > 0, F.regexp_extract(c, r"^[^:]*:(.*)$", 1)).otherwise(c)


def with_gene_ids(features: DataFrame) -> DataFrame:
    """Features (GFF columns with the map ``attr``) with ``gene_id``.

    It comes from the attribute gene_id, else from GeneID in Dbxref, else from
    ID and Parent: a gene's own id, a transcript's parent, an exon's parent's parent.
    """
    a = lambda k: F.col("attr")[k]
    named = F.coalesce(a("gene_id"), F.nullif(F.regexp_extract(a("Dbxref"), r"GeneID:([^,;]+)", 1), F.lit("")))
    base = features.withColumns({"_id": a("ID"), "_parent": F.split(a("Parent"), ",")[0], "_named": named})
    up = base.where("_id is not null").groupBy(F.col("_id").alias("_pid")).agg(F.first("_parent", True).alias("_grand"), F.first("_named", True).alias("_pnamed"))
    joined = base.join(up, base["_parent"] == up["_pid"], "left")
    inferred = F.coalesce("_named", "_pnamed", bare_id(F.coalesce("_grand", "_parent", "_id")))
    return joined.withColumn("gene_id", inferred).drop("_id", "_parent", "_named", "_pid", "_grand", "_pnamed")


def to_saf(features: DataFrame) -> DataFrame:
    """Exon rows as (GeneID, Chr, Start, End, Strand), those without a gene id left out."""
    if "gene_id" not in features.columns and "attr" not in features.columns:
        raise ValueError("'gene_id' column missing and could not be inferred")
    named = features if "gene_id" in features.columns else with_gene_ids(features)
    rows = named.where((F.col("type") == "exon") & F.col("gene_id").isNotNull())
    return rows.select(F.col("gene_id").alias("GeneID"), F.col("seqid").alias("Chr"), F.col("start").cast("int").alias("Start"), F.col("end").cast("int").alias("End"), F.col("strand").alias("Strand"))


def validate_saf(saf: DataFrame, check_rows: bool = True) -> DataFrame:
    """The table itself, if it is one of exons; an error else."""
    if not isinstance(saf, DataFrame):
        raise TypeError("annotation must be a DataFrame")
    if tuple(saf.columns) != SAF_COLUMNS:
        raise ValueError("columns of SAF data.frame must be: " + ", ".join(SAF_COLUMNS))
    if check_rows and not saf.where(" or ".join(f"{c} is null" for c in SAF_COLUMNS)).isEmpty():
        raise ValueError("SAF data.frame must not contain any NA")
    return saf


def gene_models(saf: DataFrame, fix_chr: bool = False) -> DataFrame:
    """(chrom, gene_id, start, end, strand, exons): overlapping exons merged, in order."""
    chrom = fix_chromosome("Chr") if fix_chr else F.col("Chr")
    rows = saf.select(chrom.alias("chrom"), F.col("GeneID").alias("gene_id"), F.col("Start").alias("start"), F.col("End").alias("end"), strand_sign("Strand").alias("strand"))
    outer = extent(rows, ["chrom", "gene_id"], strand="strand")
    exons = flatten(rows, ["chrom", "gene_id"]).groupBy("chrom", "gene_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return outer.join(exons, ["chrom", "gene_id"])


def missing_chromosomes(alignments: DataFrame, genes: DataFrame) -> DataFrame:
    """Contigs of the alignments that the annotation lacks."""
    return alignments.select(F.col("rname").alias("chrom")).where("chrom is not null").distinct().join(genes.select("chrom").distinct(), "chrom", "left_anti")


def check_chromosomes(alignments: DataFrame, genes: DataFrame) -> None:
    seen = alignments.select(F.col("rname").alias("chrom")).where("chrom is not null").distinct()
    if seen.join(genes.select("chrom").distinct(), "chrom", "left_semi").isEmpty():
        raise ValueError("no chromosome of the alignments is in the annotation")


def genes_of_terms(terms: DataFrame, wanted: list[str]) -> DataFrame:
    """Distinct genes of some GO terms, out of a table (go_id, gene_id)."""
    return terms.where(F.col("go_id").isin(wanted)).select("gene_id").distinct()


def convert_ids(features: DataFrame, mapping: DataFrame, feature: str = "gene_id", old: str = "old_id", new: str = "new_id", keep_all: bool = True) -> DataFrame:
    """Features with ``new_id``: the first id mapped, or their own where there is none,
    where the new one is empty or where several features would share it."""
    first = mapping.where(F.col(new).isNotNull() & (F.col(new) != "")).groupBy(old).agg(F.min(new).alias("_new"))
    joined = features.join(first.withColumnRenamed(old, feature), feature, "left")
    shared = F.count("_new").over(Window.partitionBy("_new")) > 1
    out = joined.withColumn("new_id", F.when(F.col("_new").isNull() | shared, F.col(feature) if keep_all else F.lit(None).cast("string")).otherwise(F.col("_new")))
    out = out.drop("_new")
    return out if keep_all else out.where("new_id is not null")
