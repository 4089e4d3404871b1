"""Running a stream until its input is used up, and reports of its progress."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


def as_folder(spark: SparkSession, path: str) -> str:
    """A path that a stream of files can watch: a folder, or a pattern for a single file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    is_file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return path[:-1] + "[" + path[-1] + "]" if is_file else path


def used_up(rows: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input that is there, as a table in ``place``.

    Rows are written as they come; in complete mode each batch's result takes the place
    of the one before.
    """
    spark = rows.sparkSession
    out, state = f"{place}/rows", f"{place}/state"
    writer = rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


class Progress(StreamingQueryListener):
    """Counts the rows that streams of a session read, and prints a line a batch."""

    def __init__(self, spark: SparkSession, say=None) -> None:
        self.spark, self.say = spark, say
        self.rows, self.lines, self.running = 0, [], 0

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        """Events come some time after the stream's end."""
        until = time.time() + 20
        while self.running and time.time() < until:
            time.sleep(0.05)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.running += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.lines.append(f"batch {p.batchId}: {p.numInputRows} rows, {(p.processedRowsPerSecond or 0) / 1000:.1f}k a second")
        if self.say:
            self.say(self.lines[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running -= 1
