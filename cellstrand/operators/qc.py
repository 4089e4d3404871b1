"""Quality of cells: metrics on counts, outliers, empty droplets, and tables for plots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def gene_metrics(counts: DataFrame, mito: DataFrame | None = None, ribosomal: DataFrame | None = None, spike_in: str = "ERCC-") -> DataFrame:
    """Per cell: number_of_genes, total_count_per_cell and, where their genes are there
    (any spike-in, more than one other), non_ERCC_percent, non_mt_percent, non_ribo_percent.

    ``counts`` has (gene_id, cell_id, n).  Gene sets are flags on rows, so one
    aggregate makes all; which sets are present is a small look at the genes.
    """
    rows = counts.where("n > 0").withColumn("_ercc", F.col("gene_id").startswith(spike_in))
    genes = counts.select("gene_id").distinct()
    made = [F.count("*").alias("number_of_genes"), F.sum("n").alias("total_count_per_cell")]
    total = F.sum("n")
    part = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    if not genes.where(F.col("gene_id").startswith(spike_in)).isEmpty():
        made.append((part(~F.col("_ercc")) / (total + 1e-5)).alias("non_ERCC_percent"))
    for name, members, small in (("non_mt_percent", mito, 1e-5), ("non_ribo_percent", ribosomal, 0.01)):
        if members is None:
            continue
        ids = members.select("gene_id").distinct()
        if genes.join(ids, "gene_id", "left_semi").limit(2).count() > 1:
            flag = f"_{name}"
            rows = rows.join(ids.withColumn(flag, F.lit(True)), "gene_id", "left")
            made.append(((total - part(F.coalesce(flag, F.lit(False)))) / (total + small)).alias(name))
    return rows.groupBy("cell_id").agg(*made)


def guess_organism(genes: DataFrame, gene: str = "gene_id") -> DataFrame:
    """One row (organism, gene_id_type): by which Ensembl prefix most genes have; null if few do."""
    n, human, mouse = F.count("*"), F.count_if(F.col(gene).startswith("ENSG")), F.count_if(F.col(gene).startswith("ENSMUSG"))
    name = F.when(human > n / 2, "hsapiens_gene_ensembl").when(mouse > n / 2, "mmusculus_gene_ensembl")
    kind = F.when((human > n / 2) | (mouse > n / 2), "ensembl_gene_id")
    return genes.select(gene).distinct().agg(name.alias("organism"), kind.alias("gene_id_type"))


# --- outliers: numpy on one batch of cells, a row a cell ----------------------------------


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution, by bisection on erf."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return (low + high) / 2


def chi_square_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 0.0
    head = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return head * total
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / max(abs(step * d + b), tiny) * (1 if step * d + b >= 0 else -1)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - head * h


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, df) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def chi_square_density(x: np.ndarray, df: int) -> np.ndarray:
    return np.exp((df / 2 - 1) * np.log(x) - x / 2 - (df / 2) * math.log(2) - math.lgamma(df / 2))


def mahalanobis(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)


def robust_covariance(x: np.ndarray, alpha: float = 0.7, starts: int = 60, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the subset of least determinant, made consistent and reweighted."""
    n, p = x.shape
    h = min(n, max(int(alpha * n), (n + p + 1) // 2))
    draw = np.random.default_rng(seed)
    best = (np.inf, x.mean(axis=0), np.atleast_2d(np.cov(x, rowvar=False)))
    for _ in range(starts):
        rows = draw.permutation(n)[: min(n, p + 1)]
        last = np.inf
        for _ in range(30):
            centre, cov = x[rows].mean(axis=0), np.atleast_2d(np.cov(x[rows], rowvar=False)) + 1e-12 * np.eye(p)
            rows = np.argsort(mahalanobis(x, centre, cov), kind="stable")[:h]
            det = np.linalg.det(np.atleast_2d(np.cov(x[rows], rowvar=False)))
            if abs(last - det) <= 1e-12 * max(1.0, abs(last)):
                break
            last = det
        if last < best[0]:
            best = (last, x[rows].mean(axis=0), np.atleast_2d(np.cov(x[rows], rowvar=False)))
    _, centre, cov = best
    q = chi_square_quantile(h / n, p) if h < n else np.inf
    if np.isfinite(q):
        cov = cov * (h / n) / chi_square_cdf(q, p + 2)
    cut = chi_square_quantile(0.975, p)
    kept = mahalanobis(x, centre, cov) <= cut
    if kept.sum() > p:
        centre = x[kept].mean(axis=0)
        cov = np.atleast_2d(np.cov(x[kept], rowvar=False)) * 0.975 / chi_square_cdf(cut, p + 2)
    return centre, cov


def robust_line(z: np.ndarray, y: np.ndarray, k: float = 1.345) -> tuple[float, float]:
    """Intercept and slope by iterated Huber weights."""
    design = np.stack([np.ones_like(z), z], axis=1)
    w = np.ones_like(z)
    coef = np.zeros(2)
    for _ in range(200):
        new = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = y - design @ new
        scale = max(np.median(np.abs(r)) / 0.6745, 1e-12)
        w = np.minimum(1, k * scale / np.maximum(np.abs(r), 1e-300))
        if np.abs(new - coef).max() < 1e-10:
            break
        coef = new
    return float(new[0]), float(new[1])


def beyond_quantiles(d: np.ndarray, df: int, conf: float) -> np.ndarray:
    """Distances above what a chi-square plot's confidence band lets through."""
    n = len(d)
    if n < 3:
        return np.zeros(n, bool)
    a_ = 3 / 8 if n <= 10 else 1 / 2
    prob = (np.arange(1, n + 1) - a_) / (n + 1 - 2 * a_)
    z = np.array([chi_square_quantile(p, df) for p in prob]) if n <= 2000 else np.interp(prob, *_quantile_table(df, n))
    y = np.sort(d)
    a, b = robust_line(z, y)
    error = b / chi_square_density(z, df) * np.sqrt(prob * (1 - prob) / n)
    inside = y[y < a + b * z + normal_quantile(1 - (1 - conf) / 2) * error]
    return d > (inside.max() if len(inside) else -np.inf)


def _quantile_table(df: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    grid = np.unique(np.concatenate([np.linspace(0.001, 0.999, 800), 0.5 / n + np.zeros(1), 1 - np.geomspace(0.5 / n, 0.001, 200)]))
    return grid, np.array([chi_square_quantile(p, df) for p in grid])


def mixture(x: np.ndarray, parts: int, rounds: int = 200, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(labels, means) of a Gaussian mixture, started from quantiles of the first axis."""
    n, p = x.shape
    order = np.argsort(x[:, 0], kind="stable")
    resp = np.zeros((n, parts))
    for k, rows in enumerate(np.array_split(order, parts)):
        resp[rows, k] = 1
    for _ in range(rounds):
        weight = resp.sum(axis=0) + 1e-9
        means = (resp.T @ x) / weight[:, None]
        log = np.empty((n, parts))
        for k in range(parts):
            d = x - means[k]
            cov = (resp[:, k, None] * d).T @ d / weight[k] + 1e-6 * np.eye(p)
            log[:, k] = np.log(weight[k] / n) - 0.5 * (np.linalg.slogdet(cov)[1] + mahalanobis(x, means[k], cov))
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - resp).max() < 1e-6:
            break
        resp = new
    return resp.argmax(axis=1), means


def outliers_of(x: np.ndarray, comp: int = 1, side: str = "low", conf: tuple[float, float] = (0.9, 0.99)) -> np.ndarray:
    """Which rows are outliers, on the low side, the high side or both."""
    n, p = x.shape
    if n <= p + 1:
        return np.zeros(n, bool)

    def by_side(rows: np.ndarray, sides: str) -> np.ndarray:
        centre, cov = robust_covariance(x[rows])
        d = mahalanobis(x[rows], centre, cov)
        high = np.sign(x[rows] - centre).sum(axis=1) > 0
        out = np.zeros(len(rows), bool)
        for want, mask, c in (("low", ~high, conf[0]), ("high", high, conf[1])):
            if sides in (want, "both"):
                out[mask] = beyond_quantiles(d[mask], p, c)
        return out

    everything = np.arange(n)
    if comp == 1:
        return by_side(everything, side)
    near = mahalanobis(x, x.mean(axis=0), np.atleast_2d(np.cov(x, rowvar=False))) <= chi_square_quantile(0.99, p)
    labels, means = mixture(x[near], comp)
    good = int(np.argmax(means[:, 0]))
    kept = near.copy()
    kept[np.flatnonzero(near)[labels != good]] = False
    out = ~kept
    out[kept] = by_side(np.flatnonzero(kept), "both")
    if side != "both":
        high = np.sign(x - means[good]).sum(axis=1) > 0
        out &= high if side == "high" else ~high
    return out


OUTLIER_COLUMNS = ("number_of_genes", "total_count_per_cell", "non_mt_percent", "non_ERCC_percent")


def detect_outliers(cells: DataFrame, comp: int = 1, columns: list[str] | None = None, side: str = "low", conf: tuple[float, float] = (0.9, 0.99), batch: str | None = None) -> DataFrame:
    """Cells with ``outliers``; batches are judged each by itself."""
    if side not in ("low", "high", "both"):
        raise ValueError("side must be low, high or both")
    wanted = columns or list(OUTLIER_COLUMNS)
    used = [c for c in wanted if c in cells.columns]
    if not {"number_of_genes", "total_count_per_cell"} <= set(used) and columns is None:
        raise ValueError(f"to judge cells by default columns, these are needed: {', '.join(OUTLIER_COLUMNS[:2])}")
    if not cells.where(" or ".join(f"`{c}` is null" for c in used)).isEmpty():
        raise ValueError(f"some cells lack a value in one of {', '.join(used)}")
    if not cells.where(sum((F.col(c) for c in used[1:]), F.col(used[0])) == 0).isEmpty():
        raise ValueError("cells without any count can't be judged; filter them first")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[used].to_numpy(float)
        if "total_count_per_cell" in used:
            k = used.index("total_count_per_cell")
            x[:, k] = np.log2(x[:, k] + 1)
        return pdf.assign(outliers=outliers_of(x, comp, side, conf))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", outliers boolean"
    return cells.groupBy(F.col(batch) if batch else F.lit(1).alias("_batch")).applyInPandas(judge, schema)


def remove_outliers(cells: DataFrame) -> DataFrame:
    return cells.where("not outliers").drop("outliers")


# --- empty droplets -----------------------------------------------------------------------


def ambient_profile(counts: DataFrame, lower: int) -> DataFrame:
    """(feature, p): the part of each feature in what barcodes up to ``lower`` counts hold.

    By Good and Turing the features not seen there share as much as those seen once
    have, evenly; the others share the rest as seen.  Without any seen once, each gets
    one count more.
    """
    totals = counts.groupBy("barcode").agg(F.sum("n").alias("total"))
    empty = counts.join(totals.where(F.col("total") <= lower), "barcode", "left_semi").groupBy("feature").agg(F.sum("n").alias("a"))
    every = counts.select("feature").distinct().join(empty, "feature", "left").na.fill(0, ["a"])
    whole = every.agg(F.sum("a").alias("_s"), F.count("*").alias("_f"), F.count_if(F.col("a") == 1).alias("_once"), F.count_if(F.col("a") == 0).alias("_none"))
    unseen = F.when((F.col("_once") > 0) & (F.col("_none") > 0) & (F.col("_once") < F.col("_s")), F.col("_once") / F.col("_s"))
    turing = F.when(F.col("a") == 0, unseen / F.col("_none")).otherwise(F.col("a") / F.nullif(F.col("_s"), F.lit(0)) * (1 - unseen))
    # with every feature seen nothing is kept back
    seen = F.when((F.col("_none") == 0) & (F.col("_s") > 0), F.col("a") / F.col("_s"))
    plain = (F.col("a") + 1) / (F.col("_s") + F.col("_f"))
    return every.crossJoin(F.broadcast(whole)).select("feature", F.coalesce(turing, seen, plain).alias("p"))


def false_discovery(tested: DataFrame, p: str = "p_value") -> DataFrame:
    """Rows with ``fdr`` after Benjamini and Hochberg.

    Equal p-values have equal rates, so rates are found on the distinct ones, of which a
    simulation has few, and joined to the rows.
    """
    by_p = tested.groupBy(p).agg(F.count("*").alias("_n"))
    up = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    summed = by_p.withColumns({"_until": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy())})
    rates = summed.withColumn("_raw", F.col(p) * F.col("_all") / F.col("_until")).withColumn("fdr", F.least(F.lit(1.0), F.min("_raw").over(down)))
    return tested.join(rates.select(p, "fdr"), p)


def empty_droplets(counts: DataFrame, lower: int = 1, rounds: int = 1000, seed: int = 9) -> DataFrame:
    """Per barcode above ``lower``: total, log-probability under the ambient profile,
    Monte-Carlo p value and false discovery rate.

    Counts are written once.  The profile (`ambient_profile`) has a row a feature and goes to all tasks; one
    reference table of simulated log-probabilities is drawn per total, in pandas, bounded
    by the number of features and rounds.
    """
    counts = written(counts, "counts")
    totals = counts.groupBy("barcode").agg(F.sum("n").alias("total"))
    profile = written(ambient_profile(counts, lower), "profile")
    rows = counts.join(totals.where(F.col("total") > lower), "barcode").join(profile, "feature")
    stirling = lambda n: F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise((n + 0.5) * F.log(n.cast("double")) - n + 0.9189385332046727 + 1 / (12 * n))
    own = rows.groupBy("barcode", "total").agg(F.sum(F.col("n") * F.log("p") - stirling(F.col("n"))).alias("log_probability"))
    pvec = np.array([r["p"] for r in profile.orderBy("feature").select("p").collect()])

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(key[0])
        draw = np.random.default_rng([seed, total])
        lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1)))])
        sims = []
        for _ in range(0, rounds, 50):
            x = draw.multinomial(total, pvec / pvec.sum(), size=50)
            sims.append((x * np.log(pvec)[None, :] - lf[x]).sum(axis=1))
        s = np.sort(np.concatenate(sims))
        p = (np.searchsorted(s, pdf["log_probability"].to_numpy() + 1e-9, side="right") + 1) / (len(s) + 1)
        return pdf.assign(p_value=p)

    tested = own.groupBy("total").applyInPandas(judge, "barcode string, total long, log_probability double, p_value double")
    return false_discovery(tested).select("barcode", "total", "log_probability", "p_value", "fdr")


def cells_of_droplets(tested: DataFrame, fdr: float = 0.01) -> DataFrame:
    return tested.where(F.col("fdr") <= fdr).select("barcode")


# --- tables for plots ---------------------------------------------------------------------

MAPPING_COLUMNS = ("unaligned", "aligned_unmapped", "ambiguous_mapping", "mapped_to_ERCC", "mapped_to_intron", "mapped_to_exon")


def with_places(rows: DataFrame, value: str, key: str, falling: bool = False, name: str = "place") -> DataFrame:
    """Rows with their place in order of a value, then a key, from 1.

    A row's place is the number of rows with values before its own, found on the distinct
    values, and its place among rows of the same value, so no window spans all rows.
    """
    order = F.desc("_v") if falling else F.asc("_v")
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    first = sizes.select("_v", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = rows.withColumns({"_v": F.col(value), "_k": F.row_number().over(Window.partitionBy(value).orderBy(key))})
    placed = own.join(first, own["_v"].eqNullSafe(first["_v"])).drop(first["_v"])
    return placed.withColumn(name, (F.col("_first") + F.col("_k")).cast("int")).drop("_v", "_k", "_first")


def mapping_long(cells: DataFrame, key: str = "cell_id", columns: tuple[str, ...] = MAPPING_COLUMNS, share: bool = False) -> DataFrame:
    """(key, place, type, value): a row per cell and measure; place orders cells by exon reads."""
    used = [c for c in columns if c in cells.columns]
    total = sum((F.col(c) for c in used[1:]), F.col(used[0]))
    value = lambda c: (F.col(c) / F.nullif(total, F.lit(0))) if share else F.col(c).cast("double")
    placed = with_places(cells, used[-1], key, falling=True)
    return placed.select(key, "place", *[value(c).alias(c) for c in used]).unpivot([key, "place"], used, "type", "value")


def demultiplex_shares(overall: DataFrame) -> DataFrame:
    whole = F.sum("count").over(Window.partitionBy())
    return overall.select("status", "count", (F.col("count") / F.nullif(whole, F.lit(0))).alias("share"))


def duplication_curve(histogram: DataFrame, tail: int = 10) -> DataFrame:
    """The histogram without its last slot, up to where fewer than ``tail`` molecules follow."""
    body = histogram.where("duplication_number <= 1000")
    order = Window.orderBy("duplication_number").rowsBetween(Window.unboundedPreceding, 0)
    summed = body.withColumns({"_until": F.sum("count").over(order), "_all": F.sum("count").over(Window.partitionBy())})
    cut = F.min(F.when(F.col("_all") - F.col("_until") < tail, F.col("duplication_number"))).over(Window.partitionBy())
    return summed.withColumn("_cut", cut).where("duplication_number <= _cut").select("duplication_number", "count", F.col("_until").alias("cumulative"))


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, n): equal bins between the least and the largest value."""
    ends = values.agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    k = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return values.crossJoin(F.broadcast(ends)).groupBy(k.cast("int").alias("bin"), (F.col("_low") + k * width).alias("low")).agg(F.count("*").alias("n"))


def log_histogram(stats: DataFrame, column: str, bins: int = 10) -> DataFrame:
    return histogram(stats.select(F.log(F.col(column) + 1).alias("value")), "value", bins)


def fitted_line(stats: DataFrame, x: str, y: str) -> DataFrame:
    """Intercept, slope and correlation of log(y+1) on log(x+1)."""
    a, b = F.log(F.col(x) + 1.0), F.log(F.col(y) + 1.0)
    return stats.agg(F.regr_intercept(b, a).alias("intercept"), F.regr_slope(b, a).alias("slope"), F.corr(a, b).alias("correlation"))


def ordered_features(stats: DataFrame) -> DataFrame:
    return with_places(stats, "features_per_cell", "cell")


def correlations(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one: list[Column] = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs]
    wide = cells.agg(*one)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])).alias("x")).select("x.*")


def sampled(rows: DataFrame, at_most: int, key: str, seed: int = 1) -> DataFrame:
    """A random subset of fixed size, the same in reruns: the smallest hashes of a key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed).cast("string"))), key).limit(at_most)
