"""Writers.  Everything goes through Spark's own writers, a part per task."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fastq(reads: DataFrame, path: str, name: str = "name", seq: str = "seq", qual: str = "qual", compress: bool = True, mode: str = "overwrite") -> None:
    """Four lines a read."""
    text = F.concat_ws("\n", F.concat(F.lit("@"), F.col(name)), F.col(seq), F.lit("+"), F.col(qual))
    reads.select(text.alias("value")).write.mode(mode).text(path, compression="gzip" if compress else "none")


def write_by_match_type(trimmed: DataFrame, path: str, compress: bool = True) -> None:
    """Reads that passed, a folder per match type and mate."""
    good = trimmed.where("status = 'pass'")
    for mate in (1, 2):
        name = "name" if "name" in trimmed.columns else f"name{mate}"
        text = F.concat_ws("\n", F.concat(F.lit("@"), F.col(name)), F.col(f"seq{mate}"), F.lit("+"), F.col(f"qual{mate}"))
        rows = good.select("match_type", text.alias("value"))
        rows.write.mode("overwrite").partitionBy("match_type").text(f"{path}/mate={mate}", compression="gzip" if compress else "none")


def write_alignments(alignments: DataFrame, path: str, mode: str = "overwrite", by_contig: bool = False) -> None:
    """A Parquet table of alignments, in order of place within parts if by contig."""
    if by_contig:
        alignments = alignments.repartitionByRange("rname", "pos").sortWithinPartitions("rname", "pos")
    alignments.write.mode(mode).parquet(path)


def write_cell_tables(reads: DataFrame, path: str) -> None:
    """(gene_id, UMI, position) of each cell in a folder of its own."""
    reads.write.mode("overwrite").partitionBy("cell_id").csv(path, header=True)


def write_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).csv(path, header=True)


def write_statistics(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def write_regions(regions: DataFrame, path: str, columns: tuple[str, ...] = ("chrom", "start", "end")) -> None:
    """BED: tab-separated, no header."""
    regions.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_fragments(fragments: DataFrame, path: str) -> None:
    write_regions(fragments, path, ("chrom", "start", "end", "barcode", "count"))


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_matrix(counts: DataFrame, path: str) -> None:
    """A long matrix (feature, barcode, n) as Parquet."""
    counts.write.mode("overwrite").parquet(path)


def write_report(tables: dict[str, DataFrame], path: str, title: str = "Report", rows: int = 200) -> None:
    """One HTML page with a section a table, of at most so many rows each (it says so).

    A report is for reading, so its rows are bounded and put together on the driver; the
    page itself is written by Spark.
    """
    cell = lambda x: html.escape("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x))
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        found = df.limit(rows + 1).collect()
        head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in found[:rows])
        more = f"<p>The first {rows} rows.</p>" if len(found) > rows else ""
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    spark = next(iter(tables.values())).sparkSession
    page = "".join([*parts, "</body></html>"])
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
