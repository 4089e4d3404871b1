"""BAM files: a Python data source and a writer, after the public SAM/BAM format.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load("a.bam,b.bam")

Large files are split at BGZF blocks: a partition is a range of bytes and has the
records that begin in the blocks that begin there.  Where the first of them begins is
found by trying places until a run of records makes sense (`first_record`), as records
need not begin with a block.  The option ``contig`` keeps one contig's alignments;
others are left out before their fields are decoded.  Rows travel in batches of Arrow.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from .fastq import file_size, file_system, open_seekable

# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
CIGAR_OPS = "MIDNSHP=X"
_HEX = "0123456789abcdef"
_TO_HEX = bytes(ord(_HEX[BASES.index(chr(c))]) if chr(c) in BASES else ord("f") for c in range(256))
_FROM_HEX = str.maketrans(_HEX, BASES)
_UP, _DOWN = bytes((c + 33) % 256 for c in range(256)), bytes((c - 33) % 256 for c in range(256))
_HEAD = struct.Struct("<iiBBHHHiiii")
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[tag], at = data[at:end].decode(), end + 1
        elif kind == "A":
            out[tag], at = chr(data[at]), at + 1
        elif kind == "B":
            sub = _NUMBERS[chr(data[at])]
            n = struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{sub}", data, at + 5)
            out[tag], at = ",".join(map(str, values)), at + 5 + n * struct.calcsize(sub)
        else:
            sub = _NUMBERS[kind]
            out[tag] = str(struct.unpack_from("<" + sub, data, at)[0])
            at += struct.calcsize(sub)
    return out


def read_header(f) -> list[tuple[str, int]]:
    """Names and lengths of the reference sequences."""
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    f.read(struct.unpack("<i", f.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        n = struct.unpack("<i", f.read(4))[0]
        name = f.read(n)[:-1].decode()
        out.append((name, struct.unpack("<i", f.read(4))[0]))
    return out


class Blocks:
    """The inflated bytes of a BGZF file from one block on, as one stream."""

    def __init__(self, file, at: int) -> None:
        self.file, self.next = file, at
        self.data, self.used = b"", 0
        #: Where in ``data`` each block begins that is still in it, and where in the file.
        self.begins: deque[tuple[int, int]] = deque()

    def more(self) -> bool:
        """The next block's bytes, behind those not read yet; False at the end."""
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            return False
        size = block_size(head)
        if size is None:
            raise ValueError(f"no BGZF block at byte {self.next}")
        body = zlib.decompress(head + self.file.read(size - 18), wbits=31)
        if self.used:
            self.begins = deque((k - self.used, at) for k, at in self.begins)
            while len(self.begins) > 1 and self.begins[1][0] <= 0:
                self.begins.popleft()
            self.data, self.used = self.data[self.used :], 0
        self.begins.append((len(self.data), self.next))
        self.data += body
        self.next += size
        return True

    def fill(self, n: int) -> bool:
        """Whether at least so many bytes are there to be read."""
        while len(self.data) - self.used < n:
            if not self.more():
                return False
        return True

    def block(self) -> int:
        """Where in the file the block of the next byte begins."""
        while len(self.begins) > 1 and self.begins[1][0] <= self.used:
            self.begins.popleft()
        return self.begins[0][1] if self.begins and self.begins[0][0] <= self.used else self.next

    def read(self, n: int) -> bytes:
        self.fill(n)
        out = self.data[self.used : self.used + n]
        self.used += len(out)
        return out


def block_size(head: bytes) -> int | None:
    """Size of the BGZF block that begins with these 18 bytes; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\0":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def next_block(file, at: int, size: int) -> int:
    """The place of the first block that begins at ``at`` or later; ``size`` if none does.

    What looks like a head must be followed by another or by the end of the file.
    """
    while at < size:
        file.seek(at)
        window = file.read(1 << 17)
        k = window.find(b"\x1f\x8b\x08\x04")
        while k >= 0 and k + 18 <= len(window):
            step = block_size(window[k : k + 18])
            if step is not None:
                file.seek(at + k + step)
                after = file.read(18)
                if not after or block_size(after) is not None:
                    return at + k
            k = window.find(b"\x1f\x8b\x08\x04", k + 1)
        if len(window) < 1 << 17:
            return size
        at += len(window) - 18
    return size


def _plausible(data: bytes, at: int, targets: int) -> int | None:
    """Where the record at ``at`` ends, if its fields make sense together."""
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fits = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size < 1 << 26
    if not fits or n_name < 2 or n_seq < 0 or not (-1 <= ref < targets and -1 <= next_ref < targets and pos >= -1 and next_pos >= -1):
        return None
    end = at + 36 + n_name
    if end <= len(data) and (data[end - 1] != 0 or not all(33 <= c < 127 for c in data[at + 36 : end - 1])):
        return None
    return at + 4 + size


def first_record(stream: Blocks, targets: int, run: int = 6) -> bool:
    """Goes to a stream's first record: the first place from which ``run`` records, or all
    up to the end of the file, make sense.  False if there is none."""
    while stream.fill(40):
        at, seen = stream.used, 0
        while seen < run:
            ahead = at - stream.used
            if not stream.fill(ahead + 296) and len(stream.data) - stream.used <= ahead:
                seen = run if len(stream.data) - stream.used == ahead else seen
                break
            at = stream.used + ahead
            end = _plausible(stream.data, at, targets) if len(stream.data) >= at + 40 else None
            if end is None:
                break
            at, seen = end, seen + 1
        if seen == run:
            return True
        stream.used += 1
    return False


@lru_cache(1 << 14)
def _cigar_text(ops: bytes) -> str:
    return "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in struct.unpack(f"<{len(ops) // 4}I", ops)) or "*"


@lru_cache(1 << 14)
def _cigar_bytes(cigar: str) -> bytes:
    ops, number = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | CIGAR_OPS.index(c))
            number = ""
    return struct.pack(f"<{len(ops)}I", *ops)


def alignments(path: str, begin: int = 0, end: int | None = None, contig: str | None = None) -> Iterator[tuple]:
    """The records that begin in the blocks that begin in a range of bytes of a file."""
    with open_seekable(path) as file:
        stream = Blocks(file, 0)
        targets = [name for name, _ in read_header(stream)]
        named = lambda i: targets[i] if 0 <= i < len(targets) else None
        if begin > 0:
            size = file_size(file)
            at = next_block(file, begin, size)
            if at >= size or (end is not None and at >= end):
                return
            stream = Blocks(file, at)
            if not first_record(stream, len(targets)):
                return
        wanted = None if contig is None else targets.index(contig) if contig in targets else -2
        while stream.fill(4) and (end is None or stream.block() < end):
            head = stream.read(4)
            body = stream.read(struct.unpack("<i", head)[0])
            if wanted is not None and struct.unpack_from("<i", body)[0] != wanted:
                continue
            ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = _HEAD.unpack_from(body)
            at = 31 + n_name
            qname = body[32:at].decode()
            to = at + 1 + 4 * n_cigar
            cigar = _cigar_text(body[at + 1 : to])
            at = to + (n_seq + 1) // 2
            seq = body[to:at].hex().translate(_FROM_HEX)[:n_seq]
            qual = body[at : at + n_seq]
            text = qual.translate(_UP).decode("latin-1") if qual and qual[0] != 255 else "*"
            yield qname, flag, named(ref), pos, mapq, cigar, named(next_ref), next_pos, tlen, seq, text, _tags(body[at + n_seq :])


_KINDS = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schemas.ALIGNMENTS.split(", "))])


class BamReader(DataSourceReader):
    """Options: ``contig`` (all if not given), ``splitBytes`` (bytes of a partition), ``cells``
    (a JSON list with the cell of each file, which becomes the column cell_bc)."""

    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.contig = options.get("contig")
        self.bytes = int(options.get("splitbytes", options.get("splitBytes", 1 << 27)))
        self.cells = json.loads(options["cells"]) if "cells" in options else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for p, cell in zip(self.paths, self.cells or [None] * len(self.paths), strict=True):
            with open_seekable(p) as f:
                size = file_size(f)
            out += [InputPartition((p, at, min(at + self.bytes, size), cell)) for at in range(0, max(size, 1), self.bytes)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, begin, end, cell = partition.value
        rows = alignments(path, begin, end, self.contig)
        schema = _ARROW if self.cells is None else _ARROW.append(pa.field("cell_bc", pa.string()))
        while some := list(islice(rows, 8192)):
            *plain, tags = zip(*some, strict=True)
            made = [pa.array(c, f.type) for c, f in zip(plain, schema, strict=False)]
            made.append(pa.MapArray.from_arrays(list(accumulate(map(len, tags), initial=0)), [k for t in tags for k in t], [v for t in tags for v in t.values()]).cast(schema.field("tags").type))
            yield pa.RecordBatch.from_arrays(made if self.cells is None else [*made, pa.array([cell] * len(some))], schema=schema)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schemas.ALIGNMENTS + (", cell_bc string" if "cells" in self.options else "")

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def with_tag_columns(rows: DataFrame, gene: str = "GE", barcode: str = "BC", umi: str = "OX", status: str = "YE") -> DataFrame:
    """Alignments with gene_id, cell_bc, umi and map_status out of the map of tags."""
    return rows.withColumns({"gene_id": F.col("tags")[gene], "cell_bc": F.col("tags")[barcode], "umi": F.col("tags")[umi], "map_status": F.col("tags")[status].cast("int")})


def one_file_per_cell(spark: SparkSession, paths: list[str], barcodes: list[str]) -> DataFrame:
    """Files of one cell each, with the cell's barcode; a cell may have several.  All are one scan."""
    if len(paths) != len(barcodes):
        raise ValueError("as many barcodes as files are needed")
    register(spark)
    return spark.read.format("bam").option("cells", json.dumps(list(barcodes))).load(",".join(paths))


def _block(data: bytes) -> bytes:
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_parts(alignments: DataFrame, targets: list[tuple[str, int]], folder: str) -> list[str]:
    """A BAM file for each partition of a table of alignments, in a folder that all
    executors reach; their paths.  A task writes under a name of its own attempt and
    renames, so a repeated task leaves one file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written_parts(folder, targets, [("", _rows(batches))])

    return sorted(r["path"] for r in alignments.select(_ARROW.names).mapInArrow(write, "cell string, path string").collect())


def write_cells(alignments: DataFrame, targets: list[tuple[str, int]], folder: str, cell: str) -> list[tuple[str, str]]:
    """BAM files of one cell each: (cell, path), in order.

    Rows are dealt out by range of cell and place, so a large cell is written by many tasks,
    each with a file of its own, and small cells share a task, which writes one file after
    the other.
    """
    rows = alignments.select(*_ARROW.names, F.col(cell).cast("string").alias("_cell")).where("_cell is not null")
    dealt = rows.repartitionByRange("_cell", "pos", "qname").sortWithinPartitions("_cell", "pos")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((k, (row[:-1] for row in rows)) for k, rows in groupby(_rows(batches), key=lambda row: row[-1]))
        yield from _written_parts(folder, targets, each)

    return sorted((r["cell"], r["path"]) for r in dealt.mapInArrow(write, "cell string, path string").collect())


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches as tuples; maps become lists of pairs."""
    for batch in batches:
        yield from zip(*(_pairs(column) if pa.types.is_map(column.type) else column.to_pylist() for column in batch.columns), strict=True)


def _pairs(column: pa.MapArray) -> list[list[tuple]]:
    at = column.offsets.to_pylist()
    flat = list(zip(column.keys.to_pylist(), column.items.to_pylist(), strict=True))
    return [flat[a:b] if valid else [] for a, b, valid in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def _written_parts(folder: str, targets: list[tuple[str, int]], parts: Iterable[tuple[str, Iterable[tuple]]]) -> Iterator[pa.RecordBatch]:
    """(cell, path) of a task's files, each written under a name of this attempt and renamed."""
    context = TaskContext.get()
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    for k, (cell, rows) in enumerate(parts):
        name = f"part-{context.partitionId():05d}" + (f"-{k:06d}" if cell else "") + ".bam"
        write_file(f"{inner}/{name}.{context.taskAttemptId()}", targets, rows, system)
        system.move(f"{inner}/{name}.{context.taskAttemptId()}", f"{inner}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([f"{folder}/{name}"])], names=["cell", "path"])


def write_file(path: str, targets: list[tuple[str, int]], rows: Iterable, system=None) -> None:
    """A BAM file of rows in the order of `schemas.ALIGNMENTS`; tags are written as text or numbers."""
    index = {name: i for i, (name, _) in enumerate(targets)}
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in targets).encode()
    buffer = bytearray(b"BAM\1") + struct.pack("<i", len(text)) + text + struct.pack("<i", len(targets))
    for name, size in targets:
        raw = name.encode() + b"\0"
        buffer += struct.pack("<i", len(raw)) + raw + struct.pack("<i", size)
    with system.open_output_stream(path) if system else open(path, "wb") as f:
        for qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags in rows:
            name = qname.encode() + b"\0"
            ops = _cigar_bytes(cigar or "*")
            bases = b"" if seq in (None, "*") else seq.encode()
            packed = bytes.fromhex((bases.translate(_TO_HEX) + b"0" * (len(bases) % 2)).decode())
            quality = qual.encode("latin-1").translate(_DOWN) if qual and qual != "*" else b"\xff" * len(bases)
            extra = b""
            for tag, value in tags.items() if isinstance(tags, dict) else tags or ():
                whole = value.lstrip("-").isdigit() and len(value) < 10
                extra += tag.encode() + (b"i" + struct.pack("<i", int(value)) if whole else b"Z" + value.encode() + b"\0")
            core = _HEAD.pack(index.get(rname, -1), -1 if pos is None else pos, len(name), mapq or 0, 4680, len(ops) // 4, flag, len(bases), index.get(rnext, -1), -1 if pnext is None else pnext, tlen or 0)
            body = core + name + ops + packed + quality + extra
            buffer += struct.pack("<i", len(body)) + body
            # records don't span blocks unless they are larger than one
            if len(buffer) >= 48000:
                for at in range(0, len(buffer), 60000):
                    f.write(_block(bytes(buffer[at : at + 60000])))
                buffer = bytearray()
        for at in range(0, len(buffer), 60000):
            f.write(_block(bytes(buffer[at : at + 60000])))
        f.write(_EOF)
