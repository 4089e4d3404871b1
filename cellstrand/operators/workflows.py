"""Whole runs: stages put together, tables in and tables out.

Aligning and peak calling are left to tools made for them; their results, alignments
and peaks, come in as tables.  Stages stay lazy; a sink at the end runs them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import FilterSettings, ReadStructure
from ..sources.storage import written
from . import barcodes, demux, features, fragments, intervals, mapping, matrix, qc, reads, umi
from .annotation import check_chromosomes, gene_models
from .experiment import CellExperiment, from_atac_tables, from_rna_tables

CELL_CALLING = ("filter", "emptydrops")


def trim_barcode(pairs: DataFrame, structure: ReadStructure = ReadStructure(), filters: FilterSettings = FilterSettings()) -> tuple[DataFrame, DataFrame]:
    """(trimmed reads that passed, summary)."""
    trimmed = reads.trim_paired(pairs, structure, filters)
    return trimmed.where("status = 'pass'").drop("status"), reads.trim_summary(trimmed)


def atac_trim(
    pairs: DataFrame,
    valid: DataFrame | None = None,
    barcode_reads: bool = True,
    start: int = 0,
    length: int = 16,
    second: tuple[int, int] | None = None,
    umi: tuple[int, int] | None = None,
    rmN: bool = True,
    rmlow: bool = True,
    min_qual: int = 20,
    below_min: int = 2,
    reverse_complement: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trimmed reads with match types, summary).

    Barcodes come in reads of their own (``barcode_reads``) or stand inside the mates
    at ``start`` and ``second``.  A list of valid ones is turned if that is asked for,
    or, if nothing is said, if too many of the first reads miss it (one small action).
    """
    if valid is not None:
        probe = pairs.select("ordinal", F.col("barcodes")[0]["seq"].alias("seq")) if barcode_reads else pairs.select("ordinal", F.col("seq1").alias("seq"))
        turn = reverse_complement
        if turn is None:
            turn = barcodes.needs_reverse_complement(probe, valid, start, length).first()["reverse"]
        valid = barcodes.oriented(valid, turn)
        if not barcode_reads:
            found = barcodes.start_position(probe, valid, start, length)
            if not found["ok"]:
                warnings.warn(f"{found['fraction']:.0%} of the first reads have a listed barcode at {start}; at {found['best']} it is {found['best_fraction']:.0%}", stacklevel=2)
    if barcode_reads:
        made = reads.with_barcode_reads(pairs, rmN, rmlow, min_qual, below_min, valid)
    else:
        made = reads.with_inline_barcodes(pairs, valid, (start, length), second or (start, length), umi, "both", rmN, rmlow, min_qual, below_min)
    return made, reads.match_summary(made)


def exon_mapping(alignments: DataFrame, saf: DataFrame, barcode_length: int | None = 8, umi_length: int | None = 6, stranded: bool = True, fix_chr: bool = False, key: str = "qname") -> DataFrame:
    """Alignments with barcode, UMI, gene and mapping status."""
    genes = gene_models(saf, fix_chr)
    check_chromosomes(alignments, genes)
    return mapping.map_exons(reads.tag_from_name(alignments, barcode_length, umi_length), genes, key, stranded)


def demultiplex(mapped: DataFrame, barcodes: DataFrame, most: int = 1, mito: str = "MT", has_umi: bool = True) -> dict[str, DataFrame]:
    """reads, overall_stat, cell_stat and chr_stat of mapped alignments."""
    assigned = demux.assign_cells(mapped, barcodes, most)
    return {
        "reads": demux.cell_reads(assigned, has_umi),
        "overall_stat": demux.overall_statistics(assigned),
        "cell_stat": demux.cell_statistics(assigned, barcodes, mito),
        "chr_stat": demux.chromosome_statistics(mapped),
    }


def demultiplex_and_count(mapped: DataFrame, barcodes: DataFrame, most: int = 1, mito: str = "MT", has_umi: bool = True, mode: int = 1, gene_filter: bool = False, organism: str | None = None, gene_id_type: str | None = None) -> CellExperiment:
    made = demultiplex(mapped, barcodes, most, mito, has_umi)
    counted = umi.count_genes(made["reads"], barcodes, mode, gene_filter)
    out = from_rna_tables(counted["counts"], made["cell_stat"], made["overall_stat"], counted["duplication"], organism, gene_id_type)
    out.tables |= {"chr_stat": made["chr_stat"], "dedup_stat": counted["statistics"]}
    return out


def count_aligned(alignments: DataFrame, saf: DataFrame, barcodes: DataFrame, barcode_length: int | None = 8, umi_length: int | None = 6, stranded: bool = True, fix_chr: bool = False, **options) -> CellExperiment:
    """From alignments to counts per gene and cell."""
    return demultiplex_and_count(exon_mapping(alignments, saf, barcode_length, umi_length, stranded, fix_chr), barcodes, **options)


def feature_counting(
    frags: DataFrame,
    feats: DataFrame,
    promoters: DataFrame,
    tss: DataFrame,
    enhancers: DataFrame,
    genes: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    cell_calling: str = "filter",
    thresholds: features.CellFilter = features.CellFilter(),
    cell_above: int = 200,
    feature_above: int = 10,
    lower: int = 1,
    mito: str = "chrM",
) -> dict[str, DataFrame]:
    """Counts, called cells, quality metrics and statistics of fragments on features.

    ``cell_calling``: filter (thresholds) or emptydrops, which falls back to the
    thresholds where it calls nothing.  Quality metrics use the features as given,
    before the blacklist.
    """
    if cell_calling not in CELL_CALLING:
        raise ValueError(f"cell_calling must be one of {CELL_CALLING}")
    distinct = features.distinct_features(feats)
    used = features.exclude_regions(distinct, blacklist)[0] if blacklist is not None else distinct
    counts = features.feature_counts(frags, used)
    placed = frags.withColumn("place", F.concat_ws(":", "chrom", "start", "end"))
    metrics = features.cell_qc_metrics(placed, "place", feats, promoters, tss, enhancers, mito)
    called = features.called_cells(metrics, thresholds).select("bc")
    if cell_calling == "emptydrops":
        droplets = qc.cells_of_droplets(qc.empty_droplets(counts, lower)).select(F.col("barcode").alias("bc"))
        called = droplets if not droplets.isEmpty() else called
    kept = counts.join(called.withColumnRenamed("bc", "barcode"), "barcode", "left_semi")
    kept = features.filter_counts(kept, cell_above, feature_above)
    profile = features.tss_profile(frags, tss.withColumn("_site", F.concat_ws(":", "chrom", "start")), "_site")
    per_feature = features.stats_per_feature(kept)
    flags = features.feature_flags(used.join(per_feature.select("feature"), "feature", "left_semi"), promoters, enhancers, tss, genes if genes is not None else promoters.limit(0))
    return {
        "unfiltered": counts,
        "counts": kept,
        "binary": features.binary(kept),
        "cell_qc": features.flag_called(metrics, called),
        "called": called,
        "per_cell": features.stats_per_cell(kept),
        "per_feature": per_feature.join(flags.drop("chrom", "start", "end"), "feature", "left"),
        "tss_profile": profile,
        "average": features.average_fragments_per_barcode(counts),
    }


def atac_experiment(made: dict[str, DataFrame], mapping_stats: DataFrame | None = None, organism: str | None = None, feature_type: str = "peak") -> CellExperiment:
    return from_atac_tables(made["counts"], made["per_cell"], made["cell_qc"], made["per_feature"], mapping_stats, organism, feature_type)


def atac_run(
    alignments: DataFrame,
    feats: DataFrame | None,
    promoters: DataFrame,
    tss: DataFrame,
    enhancers: DataFrame,
    sizes: DataFrame | None = None,
    bin_width: int = 2000,
    remove_duplicates: bool = False,
    organism: str | None = None,
    first: int = 0,
    **options,
) -> tuple[CellExperiment, dict[str, DataFrame]]:
    """From tagged alignments to an experiment; without features the genome is tiled.
    ``first`` is the place at which contigs begin."""
    if remove_duplicates:
        alignments = fragments.best_molecules(alignments, ["rname", "pos", "pnext", "flag"])
    frags = fragments.create_fragments(alignments, first=first)
    if feats is None:
        if sizes is None:
            raise ValueError("without features chromosome sizes are needed")
        feats = intervals.tiles(sizes, bin_width)
    made = feature_counting(frags, feats, promoters, tss, enhancers, **options)
    stats = demux.flag_statistics(alignments)
    return atac_experiment(made, stats, organism, "genome_bin" if sizes is not None else "peak"), made | {"fragments": frags, "mapping_stats": stats}


def rna_report(experiment: CellExperiment) -> dict[str, DataFrame]:
    """The tables behind a report of a counting run."""
    counts = experiment.counts.select("feature", F.col("cell").alias("barcode"), "n")
    used = matrix.abundant_features(counts)
    log = written(matrix.log_normalised(used), "log")
    variable = written(matrix.most_variable(log), "variable")
    cells = experiment.cells.withColumnRenamed("cell", "cell_id")
    genes = qc.gene_metrics(experiment.counts.select(F.col("feature").alias("gene_id"), F.col("cell").alias("cell_id"), "n"))
    return {
        "mapping": qc.mapping_long(cells),
        "mapping_share": qc.mapping_long(cells, share=True),
        "demultiplexing": qc.demultiplex_shares(experiment.demultiplex_info),
        "duplication": qc.duplication_curve(experiment.umi_dup_info),
        "metrics": genes,
        "metric_correlations": qc.correlations(genes, ["number_of_genes", "total_count_per_cell"]),
        "cpm": matrix.counts_per_million(used),
        "log": log,
        "variable": variable,
        "components": matrix.principal_components(log, variable),
        "tree": matrix.gene_tree(log, variable.orderBy(F.desc("variance"), "feature").limit(50)),
    }


def atac_report(made: dict[str, DataFrame], subset: int = 500) -> dict[str, DataFrame]:
    """The tables behind a report of an ATAC run."""
    cells, feats = made["per_cell"], made["per_feature"]
    return {
        "fractions": features.weighted_fractions(made["cell_qc"]),
        "insert_sizes": features.insert_sizes(made["fragments"]),
        "tss_profile": made["tss_profile"],
        "tss_enrichment": features.tss_enrichment(made["tss_profile"]),
        "fragments_per_cell": qc.log_histogram(cells, "counts_per_cell"),
        "features_per_cell": qc.log_histogram(cells, "features_per_cell"),
        "features_per_cell_ordered": qc.ordered_features(cells),
        "fragments_per_feature": qc.log_histogram(feats, "counts_per_feature"),
        "cells_per_feature": qc.log_histogram(feats, "cells_per_feature"),
        "fragments_features_per_cell": qc.fitted_line(cells, "counts_per_cell", "features_per_cell"),
        "fragments_cells_per_feature": qc.fitted_line(feats, "counts_per_feature", "cells_per_feature"),
        "barcode_ranks": features.size_ranks(cells, "counts_per_cell"),
        "barcode_subset": qc.sampled(made["cell_qc"], subset, "bc"),
    }


def reduced(counts: DataFrame, rank: int = 50, neighbours: int = 30) -> DataFrame:
    """(barcode, x, y, cluster): TF-IDF, truncated decomposition, neighbours, layout, communities."""
    scores = written(matrix.lsi(matrix.tf_idf(counts), rank), "scores")
    near = written(matrix.nearest_cells(scores, neighbours), "neighbours")
    return matrix.layout(scores, matrix.clusters(near), places=matrix.umap(near, scores))
