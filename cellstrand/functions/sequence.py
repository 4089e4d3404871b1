"""Column functions on nucleotide strings, qualities and read names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hamming(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Number of places that differ; null unless both strings are equally long."""
    a, b = _col(a), _col(b)
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(places, F.lit(0), lambda n, x: n + x)))


def edit_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.levenshtein(_col(a), _col(b))


def reverse_complement(s: ColumnOrName) -> Column:
    """Of A, C, G, T; everything else becomes N."""
    return F.reverse(F.translate(F.regexp_replace(_col(s), "[^ACGT]", "N"), "ACGT", "TGCA"))


def reverse_complement_iupac(s: ColumnOrName) -> Column:
    """With the ambiguity codes; S, W and N are their own complements."""
    return F.reverse(F.translate(_col(s), "ACGTRYKMBDHV", "TGCAYRMKVHDB"))


def low_quality_count(quality: ColumnOrName, most: int, offset: int = 33) -> Column:
    """How many of a quality string's characters stand for a value of at most ``most``."""
    values = F.filter(F.split(_col(quality), ""), lambda x: x != "")
    return F.size(F.filter(values, lambda x: F.ascii(x) - offset <= most))


def has_n(s: ColumnOrName) -> Column:
    return F.instr(_col(s), "N") > 0


def strand_sign(symbol: ColumnOrName) -> Column:
    """``+`` to 1, ``-`` to -1, others to 0."""
    s = _col(symbol)
    return F.when(s == "+", 1).when(s == "-", -1).otherwise(0)


def interval_position(a_start: ColumnOrName, a_end: ColumnOrName, b_start: ColumnOrName, b_end: ColumnOrName) -> Column:
    """-1 if a lies before b, 1 if behind it, 0 if they overlap."""
    return F.when(_col(a_end) < _col(b_start), -1).when(_col(a_start) > _col(b_end), 1).otherwise(0)


def fix_chromosome(name: ColumnOrName) -> Column:
    """``chr`` before short names that lack it; MT becomes chrM."""
    c = _col(name)
    return F.when(c == "MT", "chrM").when((F.length(c) > 4) | c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def chr_prefixed(name: ColumnOrName) -> Column:
    return F.concat(F.lit("chr"), _col(name))


def fragment_key(chrom: ColumnOrName, start: ColumnOrName, end: ColumnOrName, barcode: ColumnOrName) -> Column:
    return F.concat_ws("|", _col(chrom), _col(start).cast("string"), _col(end).cast("string"), _col(barcode))


def parse_fragment_key(key: ColumnOrName) -> Column:
    parts = F.split(_col(key), r"\|")
    return F.struct(parts[0].alias("chrom"), parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"), parts[3].alias("barcode"))


def zero_padded(number: ColumnOrName, width: Column | int) -> Column:
    return F.lpad(_col(number).cast("string"), width, "0")


def log2_1(x: ColumnOrName) -> Column:
    return F.log2(_col(x) + 1)


def signif2(x: ColumnOrName) -> Column:
    """Rounded to two significant digits."""
    v = _col(x).cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - 1)
    return F.when(v == 0, 0.0).otherwise(F.round(v / scale) * scale)


# --- CIGAR ----------------------------------------------------------------------------


def cigar_operations(cigar: ColumnOrName) -> Column:
    """Array of (length, op)."""
    whole = F.regexp_extract_all(_col(cigar), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("length"), F.substring(x, -1, 1).alias("op")))


def reference_length(cigar: ColumnOrName) -> Column:
    """Bases of the reference that the alignment spans."""
    return F.aggregate(F.filter(cigar_operations(cigar), lambda x: x["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda n, x: n + x["length"])


def aligned_segments(pos0: ColumnOrName, cigar: ColumnOrName) -> Column:
    """Array of (start, end) of the segments that align to the reference: from the
    0-based position to position plus length, both included, as exons are held against them."""
    begin = F.struct(_col(pos0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        stop = a["at"] + x["length"]
        moves = x["op"].isin("M", "D", "N", "=", "X")
        piece = F.array(F.struct(a["at"].alias("start"), stop.alias("end")))
        return F.struct(F.when(moves, stop).otherwise(a["at"]).alias("at"), F.when(x["op"].isin("M", "=", "X"), F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    return F.aggregate(cigar_operations(cigar), begin, step, lambda a: a["out"])


# --- protocols ------------------------------------------------------------------------


@dataclass(frozen=True)
class ReadStructure:
    """Start and length of the barcode in read 1 and read 2 and of the UMI; a start of -1: none."""

    bs1: int = -1
    bl1: int = 0
    bs2: int = 6
    bl2: int = 8
    us: int = 0
    ul: int = 6


@dataclass(frozen=True)
class FilterSettings:
    """Drop low-quality reads (more than numbq bases of at most minq) and reads with N."""

    rmlow: bool = True
    rmN: bool = True
    minq: int = 20
    numbq: int = 2


# bs1, bl1, bs2, bl2, us, ul by protocol.
PROTOCOLS = {
    "celseq": (-1, 0, 6, 8, 0, 6),
    "celseq2": (-1, 0, 6, 8, 0, 6),
    "dropseq": (-1, 0, 0, 12, 12, 8),
    "10x": (-1, 0, 0, 16, 16, 10),
    "chromiumv1": (-1, 0, 0, 16, 16, 10),
}


def read_structure(protocol: str) -> ReadStructure:
    """The read structure of a protocol, whatever its case and punctuation."""
    name = re.sub(r"[^0-9A-Za-z_]", "", protocol).lower()
    if name not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}; known are {', '.join(PROTOCOLS)}")
    return ReadStructure(*PROTOCOLS[name])
