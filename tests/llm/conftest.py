import pytest

#: Awkward documents: nulls, empties, one long text, repeated rows, odd characters.
WORDS = "the of and that with from this have which there their would about other into could only".split()


def prose(n: int, seed: int) -> str:
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "er", "ing", "s", "ly"]) + str(draw.randint(0, 9)) * (draw.random() < 0.02) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def awkward():
    texts = [None, "", "   \n\t ", "a", "<|endoftext|> x <|startoftext|>", "日本語 テキスト 😀", "a" * 3000, "word " * 3000, prose(9000, 1), "\x1c\x85 é\u0301 ñ"]
    texts += [prose(120, 2), prose(120, 2), prose(40, 3) + " mail me at jo.do@ex.example.com or +1 (212) 555-0147, card 4111 1111 1111 1111, host 10.0.0.1"]
    return [(i, t, ["en", None, "de"][i % 3], ["s0", None, "s1"][i % 3], len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, awkward):
    """With a repeated row, null ids and columns whose names the operators use inside."""
    rows = [*awkward, awkward[-1], (None, "lost words here", "en", "s0", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("id", "n", "key", "mix", "draws", "size", "keys", "class", "leaf", "ids", "length", "spans"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
