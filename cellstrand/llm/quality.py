"""Quality rules on repetition coverage.

Words are hashed once a text; rolling hashes give the n-grams of several lengths,
in numpy.  Measured are the characters inside n-grams that occur again, each
character once, as a share of the characters in words, and likewise the characters
in lines that equal an earlier line.  A text is kept if it passes the base rules
(enough words, few repeated 8-word windows), no share is above its limit and
symbols are no large part of its words.

A word's number is its first place in the text, so equal words have equal numbers
and a window's hash differs from another's with all but certainty.

Defined cases: a null text is a text without words; it fails the base rules;
repeated rows get equal results; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class QualityLimits:
    #: n-gram length in words: largest share of characters inside repeated ones.
    repeated: tuple[tuple[int, float], ...] = ((3, 0.40), (5, 0.30), (10, 0.25))
    duplicate_line_chars: float = 0.30
    symbols_per_word: float = 0.10
    min_words: int = 20
    base_percent: int = 30


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(codes: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all windows of each size, each from the one before by one word."""
    out, top = {}, max(sizes)
    h = codes
    for size in range(1, min(top, len(codes)) + 1):
        if size > 1:
            h = h[:-1] * _MULTIPLY + codes[size - 1 :]
        if size in sizes:
            out[size] = h
    return out


def again(h: np.ndarray) -> np.ndarray:
    """Which windows occur more than once."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    both = np.zeros(len(h), bool)
    both[1:] = same
    both[:-1] |= same
    out = np.empty(len(h), bool)
    out[order] = both
    return out


def covered(windows: np.ndarray, size: int, words: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(words + 1, np.int32)
    edge[: len(windows)] += windows
    edge[size : size + len(windows)] -= windows
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, limits: QualityLimits = QualityLimits()) -> dict:
    """The base measures, the coverage shares and the verdict of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    duplicate_lines = duplicate_chars = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                duplicate_lines += 1
                duplicate_chars += len(line) - sum(map(line.count, BLANKS))
            elif line.strip(BLANKS):
                seen.add(line)
    sizes = tuple(sorted({8, *(k for k, _ in limits.repeated)}))
    repeat_words, shares = 0, {k: 0.0 for k, _ in limits.repeated}
    if n >= min(sizes):
        first: dict[bytes, int] = {}
        numbers = np.fromiter(map(first.setdefault, words, range(n)), np.uint64, n)
        if len(first) < n:
            codes = (numbers + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            codes ^= codes >> np.uint64(29)
            lengths = None
            for size, h in window_hashes(codes, sizes).items():
                marked = again(h)
                if not marked.any():
                    continue
                inside = covered(marked, size, n)
                if size == 8:
                    repeat_words = int(inside.sum())
                if size in shares:
                    if lengths is None:
                        lengths = np.fromiter(map(len, words), np.int64, n)
                        if not text.isascii():
                            lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
                    shares[size] = float(lengths[inside].sum() / max(1, chars))
    base_failed = n < limits.min_words or 100 * repeat_words > limits.base_percent * n
    line_share = duplicate_chars / max(1, chars)
    kept = not base_failed and symbols <= limits.symbols_per_word * n and line_share <= limits.duplicate_line_chars
    kept = kept and all(shares[k] <= most for k, most in limits.repeated)
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": duplicate_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": kept,
        "dup_line_chars": line_share,
        "repeated": [shares[k] for k, _ in limits.repeated],
    }


def judge(df: DataFrame, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and what `measure` says; ``repeated`` has a share per n-gram length."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "repeated")

    def work():
        def step(columns):
            ids, texts = columns
            found = [measure(t, limits) for t in texts]
            return {id_col: ids} | {name: [x[name] for x in found] for name in names}

        return step

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars double, repeated array<double>"
    return map_rows(rows, work, schema)
