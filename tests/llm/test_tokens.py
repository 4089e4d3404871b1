import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellstrand.llm import packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


def snippets():
    draw = random.Random(3)
    out = ["I'll we're  don't 've 'S\n\n x\t\t y  ", "a<|endoftext|>b <|endoftext|><|endo", "日本語 émoji 😀😀 x", "   \n  \n!!??  12 34", "a" * 40, "-" * 70, "<\n're\n\n's", " 's\u00a0've"]
    return out + ["".join(draw.choice("ab '\n tshe1!.é<|>re") for _ in range(50)) for _ in range(40)]


def test_every_prefix_is_exact(byte_library):
    counter = token_counts.counter(BYTE)
    for text in snippets():
        steps = counter.steps(text)
        got = [0, *np.cumsum(steps, dtype=np.int64).tolist()]
        assert got == [len(byte_library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text


def test_budget_questions(byte_library):
    counter = token_counts.counter(BYTE)
    text = "The quick brown fox jumps over the lazy dog again and again."
    raw = counter.steps(text).tobytes()
    counts = [len(byte_library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert [token_counts.count_at(raw, 1, k) for k in range(len(text) + 1)] == counts
    assert token_counts.longest_within(raw, 1, 5) == max(k for k, c in enumerate(counts) if c <= 5)
    assert token_counts.longest_within(raw, 1, 0) == 0


def test_counts_of_a_table(spark, documents, no_documents, byte_library):
    rows = token_counts.prefix_counts(documents, BYTE).join(documents.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == 14
    for r in rows:
        text = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"], r["n_chars"]) == (len(byte_library.encode(text, add_special_tokens=False).ids), len(text.encode()), len(text))
    assert token_counts.prefix_counts(documents, BYTE).count() == documents.count()
    assert token_counts.prefix_counts(no_documents, BYTE).count() == 0


def test_words_are_the_library_s(word_library):
    tokenizer = packing.word_tokenizer(WORD)
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdeoaeithns'éß1*-") for _ in range(draw.randint(1, 24))) for _ in range(20000)]
    assert [a.tolist() for a in tokenizer.ids(words)] == [e.ids for e in word_library.encode_batch(words, add_special_tokens=False)]
    assert [a.tolist() for a in tokenizer.ids(snippets())] == [e.ids for e in word_library.encode_batch(snippets(), add_special_tokens=False)]


def test_packing(spark, documents, no_documents, word_library):
    settings = packing.PackSettings(length=256, open_bins=4)
    packed = packing.pack(documents, WORD, settings)
    rows = packed.withColumn("crc", F.crc32("ids")).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    pieces: dict = {}
    bins: dict = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= 256 and r["crc"] == zlib.crc32(bytes(r["ids"]))
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = (r["start"], ids)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, parts in pieces.items():
        whole = np.concatenate([parts[k][1] for k in sorted(parts)])
        assert whole.tolist() == [*word_library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert [parts[k][0] for k in sorted(parts)] == [256 * k for k in range(len(parts))]
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(no_documents, WORD).count() == 0


def test_best_fit_is_tight():
    draw = random.Random(0)
    sizes = [draw.randint(1, 2047) for _ in range(4000)]
    for order in (sizes, sorted(sizes, reverse=True)):
        packer = packing.BestFit(2048, packing.PackSettings().open_bins, 0)
        used: dict = {}
        for s in order:
            b, o = packer.place(s)
            assert used.get(b, 0) == o and o + s <= 2048
            used[b] = o + s
        assert packer.count <= 4096
        assert len(used) <= 1.03 * sum(sizes) / 2048
