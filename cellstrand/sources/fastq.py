"""FASTQ files as a Python data source: single, paired, and with barcode reads.

    spark.dataSource.register(FastqSource)
    spark.read.format("fastq").load(path)                      # ordinal, name, seq, qual
    spark.read.format("fastq").option("r2", path2).load(path)  # pairs
    ... .option("barcodes", "a.fq.gz,b.fq.gz")                 # and barcode reads

gzip can't be split, so a file, or a set of mates, is one partition; give many files
(a comma-separated list each) to read in parallel.  Mates go by place, names are not
compared, and reading stops at the shortest file.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas


def file_system(path: str):
    """(file system, path in it) of a local path or any that pyarrow's file systems know."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_seekable(path: str):
    system, inner = file_system(path)
    return system.open_input_file(inner)


def file_size(file) -> int:
    file.seek(0, 2)
    return file.tell()


def open_path(path: str) -> io.BufferedReader:
    """The bytes of a file, inflated if its name says so."""
    system, inner = file_system(path)
    raw = system.open_input_stream(inner, compression=None)
    return gzip.open(raw, "rb") if path.endswith(".gz") else io.BufferedReader(raw)


def records(path: str) -> Iterator[tuple[str, str, str]]:
    """(name without comment, sequence, quality); sequences may span lines."""
    with open_path(path) as f:
        line = f.readline()
        while line:
            if not line.startswith(b"@"):
                line = f.readline()
                continue
            name = line[1:].split(None, 1)[0].decode() if line[1:].strip() else ""
            seq = []
            line = f.readline()
            while line and not line.startswith(b"+"):
                seq.append(line.strip())
                line = f.readline()
            want, qual, have = sum(map(len, seq)), [], 0
            line = f.readline()
            while line and have < want:
                qual.append(line.rstrip(b"\r\n"))
                have += len(qual[-1])
                line = f.readline()
            yield name, b"".join(seq).decode(), b"".join(qual).decode()


class FastqPartition(InputPartition):
    def __init__(self, index: int, r1: str, r2: str | None, barcodes: list[str]) -> None:
        super().__init__(index)
        self.index, self.r1, self.r2, self.barcodes = index, r1, r2, barcodes


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        split = lambda key: [p for p in options.get(key, "").split(",") if p]
        self.r1, self.r2 = split("path"), split("r2")
        self.barcodes = [group.split("+") for group in split("barcodes")]
        if not self.r1 or (self.r2 and len(self.r2) != len(self.r1)) or (self.barcodes and len(self.barcodes) != len(self.r1)):
            raise ValueError("fastq: as many r2 files, and barcode groups (joined by +), as files are needed")

    def partitions(self) -> list[InputPartition]:
        at = lambda a, i, other: a[i] if a else other
        return [FastqPartition(i, p, at(self.r2, i, None), at(self.barcodes, i, [])) for i, p in enumerate(self.r1)]

    def read(self, partition: FastqPartition) -> Iterator[tuple]:
        base = partition.index << 40
        if partition.r2 is None:
            for k, (name, seq, qual) in enumerate(records(partition.r1)):
                yield base + k, name, seq, qual
            return
        mates = zip(records(partition.r1), records(partition.r2), *[records(b) for b in partition.barcodes], strict=False)
        for k, (one, two, *codes) in enumerate(mates):
            yield base + k, one[0], one[1], one[2], two[1], two[2], [(c[1], c[2]) for c in codes]


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return schemas.READ_PAIRS if self.options.get("r2") else schemas.READS

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_reads(spark: SparkSession, r1: list[str], r2: list[str] | None = None, barcodes: list[list[str]] | None = None) -> DataFrame:
    """Reads, pairs, or pairs with barcode reads; the lists go by place."""
    register(spark)
    reader = spark.read.format("fastq")
    if r2:
        reader = reader.option("r2", ",".join(r2))
    if barcodes:
        reader = reader.option("barcodes", ",".join("+".join(group) for group in barcodes))
    return reader.load(",".join(r1))
