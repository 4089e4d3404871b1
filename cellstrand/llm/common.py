"""What the training-data operators share: tables, shared storage, Arrow maps.

Every operator here takes and returns DataFrames.  Columns are picked by name
first, so extra columns of a table never clash with those an operator adds.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds as Python objects at a time.
SLICE_ROWS = 256

#: ASCII white space: every operator that splits words uses exactly this class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of so few file splits that cores would idle, dealt out to all of them.

    Large tables have more splits than there are cores and are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary one; on a cluster
    each executor would write to a disk of its own, so there that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cellstrand-"))
    return context.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage there: a lost executor re-reads the table and repeats
    nothing.  The table is columnar and has a known size, so small ones are
    broadcast by the optimizer's own threshold and large ones are not.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables as `materialise` writes them, for the time of a ``with`` block.

    What leaves the block must have been written outside of it: a lost executor may
    read its sources again.
    """

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        made, path = _written(df, name)
        self.paths.append((df.sparkSession, path))
        return made

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self.paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


def hash_sample(df: DataFrame, key: str, rows: int, where: Column | None = None, share: float = 0.25, distinct: bool = False) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hash of a key, the same in reruns.

    A count (of Parquet, from its footers) tells which hashes can be among them, so all
    tasks together, however many, send little more than ``rows`` rows to the driver.
    With a condition, which then is tested on few rows only, a table in which fewer than
    ``share`` of the rows meet it may give fewer.  ``distinct`` takes equal rows once,
    among those few.
    """
    total = df.count()
    part = min(1.0, (rows + 6 * rows**0.5 + 20) / max(1, total) / (1 if where is None else share))
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40))
    few = df.where(h < int(part * (1 << 40))) if part < 1 else df
    few = few if where is None else few.where(where)
    few = few.distinct() if distinct else few
    return few.orderBy(h, key).limit(rows)


def ids_to_join(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most ``most`` rows (some
    tens of MB); a larger one is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


@contextlib.contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Within this block joins may filter their larger side by a Bloom filter of the
    smaller before the shuffle, whatever that side's size (Spark's own limit is 10 GB).
    Spark builds the filter only while the smaller side is small enough for it."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns memory that a worker has freed to the system, so that what one task
    needed for a while does not stay with the worker, which serves many."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def map_rows(df: DataFrame, work: Callable[[], Callable[[list[list]], dict]], schema: str) -> DataFrame:
    """Map slices of rows through Python, Arrow in and Arrow out.

    ``work()`` runs once a task (to open a tokenizer or a model) and returns a
    function from the columns of a slice (lists of Python values) to the columns
    of the result, by name.  Slices are short, so memory depends on the longest
    texts and not on the size of a partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for piece in slices(batches):
            made = step([column.to_pylist() for column in piece.columns])
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, text_col: str, work: Callable[[], Callable[[list], list]]) -> DataFrame:
    """All rows and columns as they are, with other texts in one column, in slices as `map_rows`."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for piece in slices(batches):
            columns = list(piece.columns)
            columns[at] = pa.array(step(columns[at].to_pylist()), piece.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)
        give_back()

    return df.mapInArrow(run, df.schema)


def filter_texts(df: DataFrame, text_col: str, work: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows, all columns as they are, that a test of one text column keeps."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for piece in slices(batches):
            yield piece.filter(pa.array(step(piece.column(at).to_pylist()), pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def text_or_empty(column: str):
    """A text column whose nulls count as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
