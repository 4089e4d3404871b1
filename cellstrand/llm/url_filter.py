"""URL rules, and gradient-boosted trees on lexical features for what they leave open.

A rule has a host and a path; it fits that host and its subdomains if the path
starts with the rule's; the longest fitting rule decides.  Rules are DataFrame
expressions.  URLs that a rule judges are the labelled ones: from a bounded sample
of them small regression trees are boosted on the logistic loss, over histogram
bins, and judge the rest.  Features are lexical only: lengths, depth, digit ratio,
entropy, counts of parameters and marks, and how the host's suffix and labels and
the path's words were judged among the labelled URLs (smoothed shares).

Defined cases: a null URL or one without ``://`` has an empty host and path and
fits no rule; with labels of one kind only, or none, the verdict is that kind, or
``allow``; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_rows


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#``, in lower case (A to Z);
    path: from there up to ``?`` or ``#``."""
    u = F.col(url).cast("string")
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = (F.when if name is None else name.when)(fits, r.name)
        verdict = (F.when if verdict is None else verdict.when)(fits, r.verdict)
    empty = F.lit(None).cast("string")
    return (name.otherwise(empty), verdict.otherwise(empty)) if name is not None else (empty, empty)


# --- features and trees -----------------------------------------------------------------

_SPLIT = re.compile(r"[^a-z0-9]+")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def url_parts(url: str | None) -> tuple[str, str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    m = re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.S)
    return m[1].lower(), m[2], m[3]


@dataclass(frozen=True)
class SuffixStatistics:
    """Share of blocked URLs, by host suffix and by word, and over all."""

    suffix: dict[str, float]
    word: dict[str, float]
    overall: float

    @staticmethod
    def of(urls: list[str], blocked: np.ndarray, least: int = 3) -> SuffixStatistics:
        overall = float(blocked.mean()) if len(blocked) else 0.0
        suffix: dict[str, list] = {}
        word: dict[str, list] = {}
        for url, y in zip(urls, blocked, strict=True):
            host, path, _ = url_parts(url)
            for table, keys in ((suffix, _suffixes(host)), (word, set(_words(host, path)))):
                for k in keys:
                    c = table.setdefault(k, [0, 0])
                    c[0] += 1
                    c[1] += int(y)
        share = lambda t: {k: (b + 2 * overall) / (n + 2) for k, (n, b) in t.items() if n >= least}
        return SuffixStatistics(share(suffix), share(word), overall)


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2) if k <= len(labels)]


def _words(host: str, path: str) -> list[str]:
    return [w for w in _SPLIT.split(f"{host.rpartition('.')[0]} {path}".lower()) if w and not w.isdigit()]


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "parameters", "hyphens", "secure", "suffix", "domain", "words", "worst_word")


def features(url: str | None, stats: SuffixStatistics) -> list[float]:
    url = url or ""
    host, path, rest = url_parts(url)
    words = [stats.word[w] for w in _words(host, path) if w in stats.word]
    suffixes = [stats.suffix.get(s, stats.overall) for s in _suffixes(host)] + [stats.overall] * 2
    digits = sum(map(str.isdigit, url))
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), digits / max(1, len(url)), sum(map(str.isdigit, host)), _entropy(url), _entropy(host),
        rest.count("=") + rest.count("&"), host.count("-"), float(url[:6].lower() == "https:"), suffixes[0], suffixes[1],
        sum(words) / len(words) if words else stats.overall, max(words, default=stats.overall),
    ]


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as arrays: (feature, threshold, left, right, value); a feature of -1 is a leaf."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = x[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5, ridge: float = 1.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss on quantile bins."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = math.log(p / (1 - p))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, trees = np.full(len(x), start), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        tree: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, g=g, h=h, tree=tree) -> int:
            at, gs, hs = len(tree), g[rows].sum(), h[rows].sum()
            tree.append([-1, 0.0, 0, 0, -rate * gs / (hs + ridge)])
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(n < least) | (len(rows) - n < least)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                _, f, k = best
                go = binned[rows, f] <= k
                tree[at][:2] = [f, float(cuts[f][k])]
                tree[at][2] = grow(rows[go], level + 1)
                tree[at][3] = grow(rows[~go], level + 1)
            return at

        grow(np.arange(len(x)), 0)
        a = np.array(tree)
        made = (a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])
        trees.append(made)
        margin = margin + BoostedTrees(0.0, [made]).margin(x)
    return BoostedTrees(start, trees)


@dataclass(frozen=True)
class UrlModel:
    stats: SuffixStatistics
    trees: BoostedTrees

    def block(self, urls: list[str | None]) -> list[float]:
        """Probability that each URL should be blocked."""
        if not urls:
            return []
        x = np.array([features(u, self.stats) for u in urls])
        return (1 / (1 + np.exp(-self.trees.margin(x)))).tolist()


def fit(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", sample_urls: int = 4000) -> UrlModel:
    """A model of at most ``sample_urls`` different labelled URLs: those with the smallest
    hash.  Rows without a verdict are not labelled.

    Suffix and word shares come from one half of them and the trees from the other,
    so the trees don't take a URL's own label from its words.
    """
    urls = labelled.select(F.col(url_col).alias("u"), F.col(verdict_col).alias("v"))
    rows = hash_sample(urls, "u", sample_urls, F.col("u").isNotNull() & F.col("v").isNotNull(), distinct=True).collect()
    urls, y = [r["u"] for r in rows], np.array([float(r["v"] == "block") for r in rows])
    if not rows or y.min() == y.max():
        only = 6.0 if len(y) and y[0] else -6.0
        return UrlModel(SuffixStatistics({}, {}, float(only > 0)), BoostedTrees(only, []))
    first = np.arange(len(urls)) % 2 == 0
    stats = SuffixStatistics.of([u for u, a in zip(urls, first, strict=True) if a], y[first])
    x = np.array([features(u, stats) for u, a in zip(urls, first, strict=True) if not a])
    rest = y[~first]
    return UrlModel(stats, boost(x, rest if len(rest) else y[:0]) if len(rest) else BoostedTrees(-6.0, []))


def judge(df: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", cut: float = 0.5, model: UrlModel | None = None) -> DataFrame:
    """Per row: id, host, path, rule, verdict and block_score (null where a rule decides)."""
    host, path = host_and_path(url_col)
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    split = base.select("id", "url", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = split.select("*", name.alias("rule"), verdict.alias("by_rule"))
    used = model or fit(ruled, "url", "by_rule")

    def work():
        def step(columns):
            ids, urls, hosts, paths, names, by_rule = columns
            ask = [i for i, v in enumerate(by_rule) if v is None]
            scores: list[float | None] = [None] * len(ids)
            for i, s in zip(ask, used.block([urls[i] for i in ask]), strict=True):
                scores[i] = s
            verdicts = [v if v is not None else "block" if scores[i] > cut else "allow" for i, v in enumerate(by_rule)]
            return {id_col: ids, "host": hosts, "path": paths, "rule": names, "verdict": verdicts, "block_score": scores}

        return step

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return map_rows(ruled, work, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, block_score double")
