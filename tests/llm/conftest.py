import random

import pytest
from pyspark.sql import functions as F

CLASHING = ["d", "t", "h", "v", "w", "b", "k", "s", "n", "key", "node", "label", "size", "score", "taken", "kept", "spans", "rank", "host", "verdict", "c", "o", "turn_", "unit", "hits"]


@pytest.fixture(scope="session")
def crowd():
    """Adds columns whose names operators use inside."""

    def add(df):
        return df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(CLASHING) if c not in df.columns})

    return add


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages, one very long text."""
    rng = random.Random(5)
    words = [a + b for a in "ka lo mi tu re so ni pa".split() for b in "ra me ti lo su na".split()] + ["été", "größe", "the", "of"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    lines = lambda ws, k=12: "\n".join(" ".join(ws[i : i + k]) for i in range(0, len(ws), k))
    passage, base = make(60), make(200)
    rows = [(None, "odd text without id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d"), (7, lines(make(80)))]
    rows += [(8, lines(base)), (9, lines(base)), (9, lines(base)), (10, lines(base[:100] + ["changed"] + base[101:]))]
    rows += [(20 + i, lines(make(20 + i)) + "\n" + lines(passage) + "\n" + lines(make(15))) for i in range(5)]
    rows += [(30, " ".join(["the"] * 90)), (31, lines(make(20000))), (32, lines(base, 9).upper())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if n % 2 else None, [None, "s1", "s2", "s3", "s4"][n % 5], len(t) if t else None) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
