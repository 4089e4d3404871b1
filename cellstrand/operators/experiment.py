"""A cell experiment: counts, cells and features as tables, with metadata; and several together."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement_iupac
from .qc import guess_organism


@dataclass
class CellExperiment:
    """counts (feature, cell, n), cells (cell, ...), features (feature, ...), all lazy.

    ``metadata`` holds the names of quality columns, demultiplexing and duplication
    tables, organism, id type and feature type.
    """

    counts: DataFrame
    cells: DataFrame
    features: DataFrame
    metadata: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def validate(self) -> CellExperiment:
        """Checks names and that there is something; guesses the organism if unknown."""
        for name, df, need in (("counts", self.counts, {"feature", "cell", "n"}), ("cells", self.cells, {"cell"}), ("features", self.features, {"feature"})):
            if not need <= set(df.columns):
                raise ValueError(f"{name} must have columns {sorted(need)}")
        if self.cells.isEmpty() or self.features.isEmpty():
            raise ValueError("the experiment has no cells or no features")
        if not self.counts.join(self.cells, "cell", "left_anti").isEmpty():
            raise ValueError("counts has cells that cells has not")
        if self.metadata.get("organism") is None:
            found = guess_organism(self.features, "feature").first()
            self.metadata |= {"organism": found["organism"], "gene_id_type": found["gene_id_type"]}
        return self

    def _table(self, name: str, what: str) -> DataFrame | None:
        if name not in self.tables:
            warnings.warn(f"no {what} in the experiment", stacklevel=3)
            return None
        return self.tables[name]

    @property
    def qc_metrics(self) -> DataFrame | None:
        columns = self.metadata.get("qc_columns")
        if not columns:
            warnings.warn("no quality control columns in the experiment", stacklevel=2)
            return None
        return self.cells.select("cell", *columns)

    @qc_metrics.setter
    def qc_metrics(self, value: DataFrame) -> None:
        added = [c for c in value.columns if c != "cell"]
        self.cells = self.cells.drop(*added).join(value, "cell", "left")
        self.metadata["qc_columns"] = list(dict.fromkeys([*self.metadata.get("qc_columns", []), *added]))

    @property
    def demultiplex_info(self) -> DataFrame | None:
        return self._table("demultiplex_info", "demultiplexing result")

    @demultiplex_info.setter
    def demultiplex_info(self, value: DataFrame) -> None:
        self.tables["demultiplex_info"] = value

    @property
    def umi_dup_info(self) -> DataFrame | None:
        return self._table("umi_dup_info", "UMI duplication result")

    @umi_dup_info.setter
    def umi_dup_info(self, value: DataFrame) -> None:
        self.tables["umi_dup_info"] = value

    def _named(self, key: str) -> str | None:
        value = self.metadata.get(key)
        return None if value in (None, "NA") else value

    organism = property(lambda self: self._named("organism"), lambda self, v: self.metadata.update(organism=v))
    gene_id_type = property(lambda self: self._named("gene_id_type"), lambda self, v: self.metadata.update(gene_id_type=v))
    feature_type = property(lambda self: self._named("feature_type"), lambda self, v: self.metadata.update(feature_type=v))

    @property
    def feature_info(self) -> DataFrame:
        return self.features.drop("feature")

    @feature_info.setter
    def feature_info(self, value: DataFrame) -> None:
        self.features = self.features.select("feature").join(value, "feature", "left")

    def save(self, path: str) -> None:
        """Parquet tables and a JSON file of metadata, through Spark, so any store will do."""
        for name, df in {"counts": self.counts, "cells": self.cells, "features": self.features, **{f"table_{k}": v for k, v in self.tables.items()}}.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        text = json.dumps({"metadata": self.metadata, "tables": sorted(self.tables)})
        self.counts.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellExperiment:
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return CellExperiment(read("counts"), read("cells"), read("features"), about["metadata"], {k: read(f"table_{k}") for k in about["tables"]})


def from_rna_tables(counts: DataFrame, cell_stat: DataFrame, overall_stat: DataFrame, duplication: DataFrame, organism: str | None = None, gene_id_type: str | None = None) -> CellExperiment:
    """From (gene_id, cell_id, n) and the statistics tables of a counting run."""
    made = CellExperiment(
        counts.select(F.col("gene_id").alias("feature"), F.col("cell_id").alias("cell"), "n").where("n > 0"),
        cell_stat.withColumnRenamed("cell_id", "cell"),
        counts.select(F.col("gene_id").alias("feature")).distinct(),
        {"organism": organism, "gene_id_type": gene_id_type, "qc_columns": [c for c in cell_stat.columns if c != "cell_id"]},
    )
    made.demultiplex_info, made.umi_dup_info = overall_stat, duplication
    return made


def from_atac_tables(counts: DataFrame, per_cell: DataFrame, qc: DataFrame, per_feature: DataFrame, mapping: DataFrame | None = None, organism: str | None = None, feature_type: str | None = None) -> CellExperiment:
    """From (feature, barcode, n), statistics per cell and feature, and quality metrics."""
    cells = per_cell.join(qc.withColumnRenamed("bc", "cell"), "cell", "left")
    made = CellExperiment(
        counts.withColumnRenamed("barcode", "cell"),
        cells,
        per_feature,
        {"organism": organism, "feature_type": feature_type, "qc_columns": [c for c in cells.columns if c != "cell"]},
    )
    if mapping is not None:
        made.demultiplex_info = mapping
    return made


def rename_cells(experiment: CellExperiment, names: DataFrame) -> CellExperiment:
    """Cells renamed by a table (cell_name, barcode_sequence) that must have them all."""
    table = names.select(F.col("cell_name").alias("cell"), F.col("barcode_sequence").alias("_new"))
    if not experiment.cells.join(table, "cell", "left_anti").isEmpty():
        raise ValueError("Columns of the experiment not present in the annotation table")
    swap = lambda df: df.join(table, "cell").drop("cell").withColumnRenamed("_new", "cell")
    return CellExperiment(swap(experiment.counts), swap(experiment.cells), experiment.features, experiment.metadata, experiment.tables)


def reverse_cells(experiment: CellExperiment) -> CellExperiment:
    turn = lambda df: df.withColumn("cell", reverse_complement_iupac("cell"))
    return CellExperiment(turn(experiment.counts), turn(experiment.cells), experiment.features, experiment.metadata, experiment.tables)


def matched_orientation(experiment: CellExperiment, listed: DataFrame, column: str, enough: float = 0.2) -> CellExperiment:
    """The experiment, its barcodes reversed if under a fifth are listed and more are when reversed.

    Decides by two counts.
    """
    known = listed.select(F.col(column).alias("cell")).where("cell is not null").distinct()
    total = experiment.cells.count()
    hits = lambda e: e.cells.join(known, "cell", "left_semi").count()
    now = hits(experiment)
    if total and now / total < enough and hits(turned := reverse_cells(experiment)) > now:
        return turned
    return experiment


def outer_merge(frames: list[DataFrame]) -> DataFrame:
    """Full outer join of all on the columns that the next has in common with what is there."""

    def both(x: DataFrame, y: DataFrame) -> DataFrame:
        common = [c for c in x.columns if c in y.columns]
        if not common:
            raise ValueError("tables to merge have no column in common")
        left = x.select(*[F.col(c).alias(f"_l_{c}") if c in common else F.col(c) for c in x.columns])
        on = reduce(lambda a, b: a & b, (F.col(f"_l_{c}").eqNullSafe(F.col(c)) for c in common))
        joined = left.join(y, on, "full")
        return joined.select(*[F.coalesce(f"_l_{c}", c).alias(c) for c in common], *[c for c in x.columns if c not in common], *[c for c in y.columns if c not in common])

    return reduce(both, frames)


def integrate(
    experiments: dict[str, CellExperiment],
    matches: DataFrame | None = None,
    names: dict[str, DataFrame] | None = None,
    reverse: dict[str, bool] | None = None,
    cell_lines: dict[str, DataFrame] | None = None,
) -> tuple[dict[str, CellExperiment], DataFrame | None]:
    """(experiments, merged quality metrics).

    Barcodes are reversed and renamed as asked, turned if that matches the table of
    barcode matches (a column per technology) better, and get their cell line.  With
    a match table, cells that all technologies have, with no value missing, are ``shared``.
    """
    out: dict[str, CellExperiment] = {}
    for tech, e in experiments.items():
        e = reverse_cells(e) if (reverse or {}).get(tech) else e
        e = rename_cells(e, names[tech]) if names and tech in names else e
        e = matched_orientation(e, matches, tech) if matches is not None else e
        if cell_lines and tech in cell_lines:
            lines = cell_lines[tech].select(F.col("barcode").alias("cell"), "cell_line")
            e = CellExperiment(e.counts, e.cells.join(lines, "cell", "left"), e.features, e.metadata, e.tables)
        out[tech] = e
    if matches is None:
        return out, None
    parts = []
    for tech, e in out.items():
        qc = e.cells.select(F.col("cell").alias(tech), *[F.col(c).alias(f"{tech}_{c}") for c in e.cells.columns if c != "cell"])
        parts.append(qc.join(matches, tech, "left"))
    merged = outer_merge(parts)
    complete = merged.dropna()
    for tech, e in out.items():
        mark = complete.select(F.col(tech).alias("cell")).distinct().withColumn("shared", F.lit(True))
        e.cells = e.cells.join(mark, "cell", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return out, merged


def stacked_layouts(layouts: dict[str, DataFrame]) -> DataFrame:
    """Layout tables of several experiments, one under the other, with ``tech``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("tech", F.lit(t)) for t, df in layouts.items()))
