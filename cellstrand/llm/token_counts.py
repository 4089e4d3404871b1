"""Token counts of every prefix, by dynamic programming over prefixes.

For byte-pair encoding the encoding of a prefix is a prefix of encodings: exactly
one token can end it, namely the one that the token before it does not merge with.
So one pass from left to right finds, for each prefix of a piece, its last token
and thereby its number of tokens.  Pieces come from the tokenizer's own pattern;
where a cut changes the pieces (inside white space, contractions or a special
token) the count is that of the cut text.

The result keeps one signed byte per code point, the change of the count from one
prefix to the next.  `count_at` and `longest_within` answer how many tokens a
truncated text has, and how much of a text fits a budget, without encoding again.

Distinct pieces are computed once and kept in a table per worker: at most 500,000 pieces,
400,000 pairs of tokens and 100,000 beginnings, some 200 MB where texts are as varied as
that.

Defined cases: a null text counts as empty and has 0 tokens; repeated rows get equal
results; a text of any length takes time linear in it.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from operator import sub
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# White space as the tokenizer's pattern takes it, and its contractions.
_SPACES = "\t-\r\x20\x85\xa0  -     　"
_SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class PrefixCounter:
    """Prefix token counts for a byte-level BPE tokenizer file."""

    def __init__(self, path: str, limit: int = 500_000) -> None:
        whole = json.loads(Path(path).read_text(encoding="utf-8"))
        model = whole["model"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printed)]
        byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.special = [t["content"] for t in whole["added_tokens"]]
        named = {t for t in self.special}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in named}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        #: By id: (rank of its merge, left part, right part).
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[left, right] = k
            self.parts.setdefault(made, (k, left, right))
        self.limit = limit
        self._pairs: dict[int, bool] = {}
        self._table: dict[str, bytes] = {}
        self._begun: dict[bytes, tuple[list[int], list[int]]] = {}
        s = _SPACES
        self._units = regex.compile(rf"(?:[{s}]*(?! )[{s}])?(?:{'|'.join(_SHORT)})|[{s}]*(?:\p{{L}}+|\p{{N}}+|[^{s}\p{{L}}\p{{N}}]+)|[{s}]+")
        latin = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA1, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC)]
        of = lambda kind: "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == kind)
        b, letters, numbers = "\t-\r ", of("L"), of("N")
        #: The same units, several times faster, for texts of these characters only.
        self._latin_units = re.compile(rf"(?:[{b}]*[\t-\r])?(?:{'|'.join(_SHORT)})|[{b}]*(?:[{letters}]+|[{numbers}]+|[^{b}{letters}{numbers}]+)|[{b}]+")
        self._odd = re.compile("[^" + "".join(re.escape(c) for c in latin) + "]")
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._blank = regex.compile(rf"[{s}]*")

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens at one edge of a token: (id, rank at which it comes up, rank at which it is used up)."""
        out, gone = [], float("inf")
        while True:
            made = self.parts.get(token)
            out.append((token, made[0] if made else -1, gone))
            if made is None:
                return out
            gone, token = made[0], made[side]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two tokens that stand side by side are left so by the merges.

        They are not if some tokens at their common border, both there at once,
        have a merge.  Of equal merges the one further left comes first.
        """
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            known = True
            right = self._spine(b, 1)
            for x, x_from, x_until in self._spine(a, 2):
                for y, y_from, y_until in right:
                    m = self.rank.get((x, y))
                    if m is not None and (t := max(m, x_from, y_from)) < x_until and t <= y_until:
                        known = False
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def piece_counts(self, body: bytes) -> list[int]:
        """Number of tokens of every prefix (0 to all bytes) of one piece."""
        n, ids, longest, pairs = len(body), self.ids, self.longest, self._pairs
        # pieces share beginnings; those of a few lengths are kept
        known, count, last = 0, [0], [0]
        for k in (9, 6, 3):
            if k <= n and (found := self._begun.get(body[:k])):
                known, (count, last) = k, found
                break
        count, last = count + [0] * (n - known), last + [0] * (n - known)
        for end in range(known + 1, n + 1):
            # exactly one start is right; short tokens are the likeliest
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = ids.get(body[start:end])
                if token is None:
                    continue
                if start:
                    apart = pairs.get(last[start] << 32 | token)
                    if apart is None:
                        apart = self.stay_apart(last[start], token)
                    if not apart:
                        continue
                count[end], last[end] = count[start] + 1, token
                break
        for k in (3, 6, 9):
            if known < k <= n:
                if len(self._begun) > 100_000:
                    self._begun.clear()
                self._begun[body[:k]] = count[: k + 1], last[: k + 1]
        return count

    def _by_character(self, piece: str) -> list[int]:
        """As `piece_counts`, after 0, 1, ... code points."""
        counts = self.piece_counts(piece.encode("utf-8", "replace"))
        if len(counts) == len(piece) + 1:
            return counts
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode("utf-8", "replace"))
            out.append(counts[at])
        return out

    def unit_counts(self, unit: str) -> list[int]:
        """Prefix counts of a contraction, or of white space and the piece after it."""
        if unit in _SHORT:
            return [*range(len(unit)), self._by_character(unit)[-1]]
        blanks = self._blank.match(unit).end()
        if blanks == len(unit) or not blanks:
            return self._by_character(unit)
        space, body = unit[:blanks], unit[blanks:]
        inside = self._by_character(space)  # a cut in here leaves white space alone
        so_far = inside[blanks - 1]
        if space[-1] == " ":
            rest = self._by_character(" " + body)[2:]
        else:
            so_far += self._by_character(space[-1])[-1]
            rest = self.unit_counts(body)[1:]
        return inside + [so_far + c for c in rest]

    def _steps(self, unit: str) -> list[int]:
        if unit.isascii() and unit.lstrip(" ").isalpha() and unit[1:2] != " ":
            counts = self.piece_counts(unit.encode())
        else:
            counts = self.unit_counts(unit)
        return list(map(sub, counts[1:], counts))

    def _plain(self, text: str) -> list[int] | bytes:
        """Steps of a text without special tokens."""
        table = self._table
        units = (self._units if self._odd.search(text) else self._latin_units).findall(text)
        try:
            return b"".join(map(table.__getitem__, units))
        except KeyError:
            pass
        if len(table) > self.limit:
            table.clear()
        wide = False
        for u in units:
            if u not in table:
                steps = self._steps(u)
                if max(steps) > 127 or min(steps) < -127:
                    wide = True
                elif len(u) <= 200:
                    table[u] = array("b", steps).tobytes()
        if wide:
            return [s for u in units for s in self._steps(u)]
        return b"".join(table[u] if u in table else array("b", self._steps(u)).tobytes() for u in units)

    def steps(self, text: str | None) -> np.ndarray:
        """Change of the token count with each code point."""
        text = text or ""
        parts = self._split.split(text) if self._split and "<|" in text else [text]
        if len(parts) == 1:
            found = self._plain(text)
            return np.frombuffer(found, np.int8) if isinstance(found, bytes) else np.array(found, np.int32)
        out = []
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            found = self._plain(parts[k] + special[:-1])
            one = np.frombuffer(found, np.int8).astype(np.int32) if isinstance(found, bytes) else np.array(found, np.int32)
            out.append(one)
            if special:
                out.append(np.array([1 - one[len(parts[k]) :].sum()], np.int32))
        return np.concatenate(out)


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter a worker, whose table serves all its tasks."""
    return PrefixCounter(path)


def prefix_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_chars, n_tokens, steps (binary) and step_bytes.

    ``steps`` has a little-endian signed number of ``step_bytes`` bytes (1, and 4 in
    the rare text with a larger change) for each code point.
    """

    def work():
        count = counter(tokenizer_path)

        def step(columns):
            ids, texts = columns
            out = {id_col: ids, "n_bytes": [], "n_chars": [], "n_tokens": [], "steps": [], "step_bytes": []}
            for text in texts:
                text = text or ""
                steps = count.steps(text)
                if steps.dtype != np.int8 and (not len(steps) or np.abs(steps).max() <= 127):
                    steps = steps.astype(np.int8)
                out["n_bytes"].append(len(text) if text.isascii() else len(text.encode("utf-8", "replace")))
                out["n_chars"].append(len(text))
                out["n_tokens"].append(int(steps.sum(dtype=np.int64)))
                out["steps"].append(steps.tobytes())
                out["step_bytes"].append(steps.dtype.itemsize)
            return out

        return step

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return map_rows(rows, work, f"`{id_col}` {kind}, n_bytes long, n_chars long, n_tokens long, steps binary, step_bytes int")


def _decoded(steps: bytes, step_bytes: int) -> np.ndarray:
    return np.frombuffer(steps, np.int8 if step_bytes == 1 else np.dtype("<i4"))


def count_at(steps: bytes, step_bytes: int, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(_decoded(steps, step_bytes)[:n_chars].sum(dtype=np.int64))


def longest_within(steps: bytes, step_bytes: int, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    counts = np.cumsum(_decoded(steps, step_bytes), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
