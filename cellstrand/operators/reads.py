"""Trimming reads: barcodes and UMIs move into the read name; filters and their tallies.

Inputs are the tables of `cellstrand.schemas` (a row per read pair).  Results carry a
``status`` so that the tallies are one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import FilterSettings, ReadStructure, has_n, low_quality_count
from .barcodes import first_within, prefix_match


def _part(c: str, start: int, length: int) -> Column:
    return F.substring(c, start + 1, length)


def _from(c: str, start: int) -> Column:
    return F.expr(f"substring({c}, {start + 1})")


def trim_paired(pairs: DataFrame, structure: ReadStructure = ReadStructure(), filters: FilterSettings = FilterSettings(), raw_quality: bool = False) -> DataFrame:
    """One read per pair: name ``barcodes_umi#name``, sequence and quality of read 1
    behind its barcode, and status pass, low_quality or has_n.

    Pairs shorter than the structure are left out and counted nowhere.  Quality is
    tested before N.  ``raw_quality`` compares characters with minq as they are,
    without taking off 33.
    """
    s = structure
    end1 = s.bs1 + s.bl1 if s.bs1 >= 0 else 0
    end2 = max(s.bs2 + s.bl2, s.us + s.ul if s.us >= 0 else 0)
    long_enough = pairs.where((F.length("seq1") >= end1) & (F.length("seq2") >= end2))
    barcode = _part("seq2", s.bs2, s.bl2)
    if s.bs1 >= 0:
        barcode = F.concat(_part("seq1", s.bs1, s.bl1), barcode)
    umi = _part("seq2", s.us, s.ul) if s.us >= 0 else F.lit("")
    name = F.concat(barcode, F.lit("_"), umi, F.lit("#"), F.col("name"))
    offset = 0 if raw_quality else 33
    low = lambda q, n: low_quality_count(F.substring(q, 1, n), filters.minq, offset) > filters.numbq
    status = F.lit("pass")
    if filters.rmN:
        status = F.when(has_n(F.substring("seq1", 1, end1)) | has_n(F.substring("seq2", 1, end2)), "has_n").otherwise(status)
    if filters.rmlow:
        status = F.when(low("qual1", end1) | low("qual2", end2), "low_quality").otherwise(status)
    return long_enough.select("ordinal", name.alias("name"), _from("seq1", end1).alias("seq"), _from("qual1", end1).alias("qual"), status.alias("status"))


def trim_summary(trimmed: DataFrame) -> DataFrame:
    """One row: passed, removed_n, removed_low_quality."""
    count = lambda s: F.count_if(F.col("status") == s)
    return trimmed.agg(count("pass").alias("passed"), count("has_n").alias("removed_n"), count("low_quality").alias("removed_low_quality"))


def with_barcode_reads(triples: DataFrame, rmN: bool = False, rmlow: bool = False, min_qual: int = 20, below_min: int = 2, valid: DataFrame | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Reads with barcodes from reads of their own (array ``barcodes`` of seq and qual).

    The barcodes stand before both names, that of the last file first.  With a list
    of valid barcodes each is replaced by its match (`prefix_match`, by quality) and
    ``match_type`` says exact (all), partial (some match) or none.  ``window`` (start,
    length) is the place of the barcode within its read; else it is the whole read.
    """
    if window:
        cut = lambda c: F.substring(c, window[0] + 1, window[1])
        triples = triples.withColumn("barcodes", F.transform("barcodes", lambda b: F.struct(cut(b["seq"]).alias("seq"), cut(b["qual"]).alias("qual"))))
    bad_n = F.exists("barcodes", lambda b: F.instr(b["seq"], "N") > 0)
    bad_q = F.exists("barcodes", lambda b: low_quality_count(b["qual"], min_qual) > below_min)
    status = F.lit("pass")
    if rmN:
        status = F.when(bad_n, "has_n").otherwise(status)
    if rmlow:
        status = F.when(bad_q, "low_quality").otherwise(status)
    reads = triples.withColumn("status", status)
    if valid is None:
        used = reads.withColumns({"_codes": F.transform("barcodes", lambda b: b["seq"]), "match_type": F.lit("exact")})
    else:
        flat = reads.select("ordinal", F.posexplode("barcodes").alias("k", "b")).select("ordinal", "k", F.col("b.seq").alias("seen"), F.col("b.qual").alias("bq"))
        matched = prefix_match(flat.select("seen", "bq").distinct(), valid, "seen", "barcode", "bq")
        joined = flat.join(matched, ["seen", "bq"], "left")
        code = F.coalesce("barcode", "seen")
        kind = F.when(F.col("position") < 0, 0).when(F.col("position") >= 0, 1).otherwise(2)
        per = joined.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("k", code.alias("c"), kind.alias("kind")))).alias("m"))
        per = per.select("ordinal", F.transform("m", lambda x: x["c"]).alias("_codes"), F.transform("m", lambda x: x["kind"]).alias("_kinds"))
        match = F.when(F.forall("_kinds", lambda x: x == 0), "exact").when(F.exists("_kinds", lambda x: x < 2), "partial").otherwise("none")
        used = reads.join(per, "ordinal", "left").withColumn("match_type", F.coalesce(match, F.lit("none")))
    name = F.concat_ws("#", F.reverse("_codes"), F.col("name"))
    return used.select("ordinal", name.alias("name"), "seq1", "qual1", "seq2", "qual2", "match_type", "status")


def with_inline_barcodes(
    pairs: DataFrame,
    valid: DataFrame | None = None,
    id1: tuple[int, int] = (0, 16),
    id2: tuple[int, int] = (0, 16),
    umi: tuple[int, int] | None = None,
    umi_in: str = "both",
    rmN: bool = False,
    rmlow: bool = False,
    min_qual: int = 20,
    below_min: int = 2,
) -> DataFrame:
    """Reads with the barcode at a place inside both mates, which is cut off.

    ``match_type`` is the worse of the two mates': exact (listed), partial (one
    substitution from a listed one) or none.  The barcode text stays as read.
    """
    ends, codes = {}, {}
    for m, (start, length) in ((1, id1), (2, id2)):
        has_umi = umi is not None and umi_in in ("both", f"R{m}")
        ends[m] = max(start + length, sum(umi) if has_umi else 0)
        code = _part(f"seq{m}", start, length)
        codes[m] = F.concat(code, F.lit("_"), _part(f"seq{m}", *umi)) if has_umi else code
    bad_n = has_n(F.substring("seq1", 1, ends[1])) | has_n(F.substring("seq2", 1, ends[2]))
    low = lambda m: low_quality_count(F.substring(f"qual{m}", 1, ends[m]), min_qual) > below_min
    status = F.lit("pass")
    if rmN:
        status = F.when(bad_n, "has_n").otherwise(status)
    if rmlow:
        status = F.when(low(1) | low(2), "low_quality").otherwise(status)
    rows = pairs.select(
        "ordinal",
        *[F.concat(codes[m], F.lit("#"), F.col("name")).alias(f"name{m}") for m in (1, 2)],
        *[_part(f"seq{m}", *(id1 if m == 1 else id2)).alias(f"_b{m}") for m in (1, 2)],
        *[_from(f"{c}{m}", ends[m]).alias(f"{c}{m}") for m in (1, 2) for c in ("seq", "qual")],
        status.alias("status"),
    )
    if valid is None:
        return rows.drop("_b1", "_b2").withColumn("match_type", F.lit("exact"))
    listed = valid.select("barcode").distinct()
    for m in (1, 2):
        seen = rows.select(F.col(f"_b{m}").alias("seen")).distinct()
        near = first_within(seen, listed, 1).select(F.col("seen").alias(f"_b{m}"), F.lit(1).alias(f"_near{m}"))
        rows = rows.join(near, f"_b{m}", "left").join(listed.select(F.col("barcode").alias(f"_b{m}"), F.lit(1).alias(f"_exact{m}")), f"_b{m}", "left")
        rows = rows.withColumn(f"_k{m}", F.when(F.col(f"_exact{m}").isNotNull(), 0).when(F.col(f"_near{m}").isNotNull(), 1).otherwise(2))
    kind = F.element_at(F.array(F.lit("exact"), F.lit("partial"), F.lit("none")), F.greatest("_k1", "_k2") + 1)
    return rows.withColumn("match_type", kind).select("ordinal", "name1", "seq1", "qual1", "name2", "seq2", "qual2", "match_type", "status")


def match_summary(trimmed: DataFrame, barcodes: str | None = None) -> DataFrame:
    """One row: all reads, removals, match types among the rest, distinct barcodes seen."""
    good = F.col("status") == "pass"
    made = [F.count("*").alias("total")]
    made += [F.count_if(F.col("status") == s).alias(f"removed_{s}") for s in ("has_n", "low_quality")]
    made += [F.count_if(good & (F.col("match_type") == k)).alias(f"{k}_match") for k in ("exact", "partial", "none")]
    name = barcodes or ("name" if "name" in trimmed.columns else "name1")
    made.append(F.countDistinct(F.regexp_extract(name, "^([^#_]*)", 1)).alias("barcodes_seen"))
    return trimmed.agg(*made)


def tag_from_name(alignments: DataFrame, barcode_length: int | None = None, umi_length: int | None = None) -> DataFrame:
    """cell_bc and umi out of read names, by fixed lengths or by the marks ``_`` and ``#``.

    With lengths, a name starts with the barcode, one mark and the UMI.
    """
    if barcode_length:
        bc = F.substring("qname", 1, barcode_length)
        umi = F.substring("qname", barcode_length + 2, umi_length) if umi_length else F.lit(None).cast("string")
        return alignments.withColumns({"cell_bc": bc, "umi": umi})
    pattern = r"^([^_#]+)(?:_([^#]+))?#"
    empty = lambda c: F.when(c != "", c)
    return alignments.withColumns({"cell_bc": empty(F.regexp_extract("qname", pattern, 1)), "umi": empty(F.regexp_extract("qname", pattern, 2))})
