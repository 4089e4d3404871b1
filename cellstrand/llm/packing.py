"""Best-fit packing of token sequences.

Texts become token ids (and a closing id 0).  A document longer than a sequence is
cut into whole sequences and a remainder; nothing else is cut.  Remainders go to
the open bin with the least free space that holds them.  Open bins are a bitset
keyed by free space, so the best one is the lowest set bit not below the length.
Their number is fixed; when a new bin would be one too many, the fullest closes.

Every task packs its own rows as they come, in slices that are sorted by falling
length first, so nothing is shuffled and memory is bounded by a slice and the open
bins.  A task's sequences are numbered from its partition, and a repeated task
makes the same ones.

Words are encoded once each and kept in a bounded table.  The tokenizer library takes
some 10 microseconds a word, so new words go through tiktoken with the same merges as
ranks; tests hold both against each other.  Texts with characters outside the common
Latin ones, or with the text of a special token, go to the library as a whole.

Defined cases: a null or empty text is the one id 0; repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back


@dataclass(frozen=True)
class PackSettings:
    tokenizer: str = "word_bpe_49k.json"
    length: int = 2048
    open_bins: int = 4096
    end_id: int = 0
    #: Rows that are sorted and packed together.
    slice_rows: int = 2048


class WordTokenizer:
    """The library's ids of whole texts, by way of a table of words.

    Holds for the tokenizer whose pattern is `_pieces`: lower case, white space
    dropped, every piece encoded by itself and ended by a ``</w>`` token.
    """

    _LATIN = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC)]

    def __init__(self, path: str, limit: int = 100_000) -> None:
        self.path, self.limit = path, limit
        of = lambda kind: "".join(re.escape(c) for c in self._LATIN if unicodedata.category(c)[0] == kind)
        letters, numbers = of("L"), of("N")
        self._pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")
        self._odd = re.compile("[^" + "".join(re.escape(c) for c in self._LATIN) + "]")
        self._merger, self._id_of, self._closes = self._ranked(path)
        self._clear()
        give_back()

    @functools.cached_property
    def library(self):
        """The library's tokenizer, read when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranked(path: str):
        """The merges as tiktoken ranks, a word ending in the byte 0, and the id of each rank."""
        import tiktoken

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printed)]
        byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in body) + b"\0" * (len(body) < len(token))

        units = [t for t in model["vocab"] if len(t) == 1 or (len(t) == 5 and t.endswith("</w>"))]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = np.zeros(256 + len(units) + len(made), np.uint32)
        for token in [*sorted(units), *made]:
            key = raw(token)
            rank = ranks.setdefault(key, len(ranks))
            ids[rank] = model["vocab"][token]
        closes = np.zeros(len(ids), bool)
        for key, rank in ranks.items():
            closes[rank] = key.endswith(b"\0")
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ids, closes

    def _clear(self) -> None:
        tokenizer = self

        class Table(dict):
            def __missing__(self, word: str) -> int:
                code = self[word] = len(self)
                tokenizer._new.append(word)
                return code

        self._new: list[str] = []
        self._table = Table()
        self._flat = np.empty(1 << 16, np.uint32)
        self._first = np.empty(1 << 14, np.int64)
        self._count = np.empty(1 << 14, np.int64)
        self._words = self._used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a)), a.dtype)])

    def _learn(self) -> None:
        """Encode the new words in one call; the ranks that hold the byte 0 end them."""
        new, self._new = self._new, []
        ranks = np.array(self._merger.encode_ordinary("\0".join(new) + "\0"), np.int64)
        ids = self._id_of[ranks]
        ends = np.flatnonzero(self._closes[ranks]) + 1
        n, m = self._words, len(new)
        self._first, self._count = self._room(self._first, n + m), self._room(self._count, n + m)
        self._flat = self._room(self._flat, self._used + len(ids))
        self._flat[self._used : self._used + len(ids)] = ids
        starts = np.concatenate([[0], ends[:-1]])
        self._first[n : n + m] = self._used + starts
        self._count[n : n + m] = ends - starts
        self._words, self._used = n + m, self._used + len(ids)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._table) > self.limit:
            self._clear()
        found: list[list[str] | None] = []
        for text in texts:
            plain = self._odd.search(text) is None and "<|" not in text
            found.append(self._pieces.findall(text.lower()) if plain else None)
        pieces = [w for f in found if f for w in f]
        codes = np.fromiter(map(self._table.__getitem__, pieces), np.int64, len(pieces))
        if self._new:
            self._learn()
        counts = self._count[codes]
        until = np.cumsum(counts)
        total = int(until[-1]) if len(until) else 0
        flat = self._flat[np.repeat(self._first[codes] - (until - counts), counts) + np.arange(total)]
        out, word, token = [], 0, 0
        for text, f in zip(texts, found, strict=True):
            if f is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            word += len(f)
            stop = int(until[word - 1]) if word else 0
            out.append(flat[token:stop])
            token = stop
        return out


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One a worker, whose table serves all its tasks."""
    return WordTokenizer(path)


class BestFit:
    """Bounded-space online best-fit with a bitset of free space."""

    def __init__(self, length: int, open_bins: int, first_id: int) -> None:
        self.length, self.open_bins, self.next_id = length, open_bins, first_id
        self.bits, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to ``length``."""
        if fits := self.bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.next_id
            self.next_id += 1
        left = free - size
        if left:
            if self.count == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.length - free


def pack(df: DataFrame, tokenizer_path: str, settings: PackSettings = PackSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset."""
    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    width = settings.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        packer = BestFit(width, settings.open_bins, TaskContext.get().partitionId() << 40)
        for whole in batches:
            for at in range(0, whole.num_rows, settings.slice_rows):
                batch = whole.slice(at, settings.slice_rows)
                names = batch.column(0).to_pylist()
                texts = [t or "" for t in batch.column(1).to_pylist()]
                pieces = []
                for i in range(0, len(texts), 256):
                    for k, ids in enumerate(tokenizer.ids(texts[i : i + 256]), i):
                        ids = np.append(ids, np.uint32(settings.end_id))
                        pieces += [(names[k], j, s, ids[s : s + width]) for j, s in enumerate(range(0, len(ids), width))]
                pieces.sort(key=lambda p: -len(p[3]))
                placed = [packer.place(len(p[3])) for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pieces], batch.column(0).type),
                        pa.array([p[1] for p in pieces], pa.int32()),
                        pa.array([p[2] for p in pieces], pa.int64()),
                        pa.array([len(p[3]) for p in pieces], pa.int64()),
                        pa.array([p[3].astype("<u4").tobytes() for p in pieces], pa.binary()),
                        pa.array([b for b, _ in placed], pa.int64()),
                        pa.array([o for _, o in placed], pa.int64()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids", "sequence_id", "offset"],
                )
        give_back()

    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
