"""Queries of streams: the tables read as a stream until they are used up, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demux
from ..sources.storage import new_place
from ..streaming import fragments, run
from .assay import TABLES, _spark, sql
from .catalog import ORACLE_SQL, query
from .registry import _FLAG_SQL, _HIST


def stream(spark, d, table, *expressions):
    """A table of the given folder as a stream of files."""
    path = f"{d}/{table}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(run.as_folder(spark, path))
    return rows.selectExpr(*expressions)


def framed(spark, d, name, *more):
    table, columns = TABLES[name]
    return stream(spark, d, table, *[f"{_spark(e)} as `{c}`" for c, e in columns.items()], *more)


@query(ORACLE_SQL["fragment_pairs"])
def stream_fragment_pairs(spark, d):
    ends = framed(spark, d, "v_ends", "cast(o_orderdate as timestamp) as ts")
    return run.used_up(fragments.paired_stream(ends), new_place(spark, "pairs")).withColumnRenamed("end", "stop")


@query(sql("v_reads") + _HIST + " SELECT barcode, n FROM h")
def stream_barcode_counts(spark, d):
    reads = framed(spark, d, "v_reads").withColumn("name", F.concat("cell_bc", "qname"))
    return run.used_up(fragments.barcode_counts_stream(reads, 6), new_place(spark, "counts"), "complete")


_CLASS = "CASE " + " ".join(f"WHEN f IN ({', '.join(map(str, fs))}) THEN '{n}'" for n, fs in demux.FLAG_CLASSES.items()) + " END"


@query(f"WITH r AS (SELECT CAST(user_id AS VARCHAR) AS barcode, {_FLAG_SQL} AS f FROM events), t AS (SELECT barcode, {_CLASS} AS type FROM r) SELECT barcode, type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY 1, 2")
def stream_flag_counts(spark, d):
    rows = stream(spark, d, "events", "cast(user_id as string) as cell_bc", f"{_FLAG_SQL} as flag")
    return run.used_up(fragments.flag_counts_stream(rows), new_place(spark, "flags"), "complete")


@query("SELECT count(*) AS n_rows, count(*) > 0 AS reported FROM events")
def stream_progress(spark, d):
    rows = stream(spark, d, "events", "event_id")
    with run.Progress(spark) as seen:
        run.used_up(rows, new_place(spark, "progress"))
    return spark.createDataFrame([(seen.rows, bool(seen.lines))], "n_rows long, reported boolean")
