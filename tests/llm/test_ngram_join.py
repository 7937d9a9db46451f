import random

import pytest

from codequarry.llm.common import words_of
from codequarry.llm.ngram_join import banding, ngram_join


def brute(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None)
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    label = {s: n for n, s in enumerate(kinds)}
    linked = {s: [o for o in kinds if o != s and len(s & o) >= t * len(s | o) - 1e-9] for s in kinds}
    for s in kinds:
        for o in linked[s]:
            a, b = label[s], label[o]
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    first = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            first[label[s]] = min(first.get(label[s], i), i)
    return sorted([(i, first.get(label[s]) if s else i, len(linked[s]) if s else 0, sets.count(s) if s else 1) for (i, _), s in zip(rows, sets)], key=str)


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [128, 16, 3])
def test_classes_and_links_match_brute_force(spark, docs, texts, family, crowd, block):
    rows = [(i, t) for i, t in texts] + [(1000 + i, t) for i, t in family]
    df = crowd(spark.createDataFrame(rows, "doc_id long, text string"))
    got = ngram_join(df, block=block)
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got.collect()], key=str) == brute(rows)


def test_links_of_a_large_group_do_not_depend_on_blocks(spark):
    """500 near copies at about the threshold: all links of the component count, however it is cut."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        for k in rng.sample(range(2, 118), 2):
            w[k] = f"x{i}.{k}"
        rows.append((None if i % 3 == 0 else i, " ".join(w)))
    rows += [rows[0]] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (1024, 40):
        assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(df, block=block).collect()], key=str) == want


def test_texts_of_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xfe a b c d e f")), (2, bytearray(b"\xff\xfe A b, c d e f")), (3, bytearray(b"\xc3( b"))], "doc_id long, raw binary")
    got = {r.doc_id: (r.class_id, r.n_copies) for r in ngram_join(df.selectExpr("doc_id", "cast(raw as string) as text")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_nothing(none):
    assert ngram_join(none).count() == 0


def test_banding_meets_its_recall():
    for t, r in ((0.8, 0.99), (0.8, 0.999), (0.6, 0.9)):
        b, k = banding(t, r)
        assert 1 - (1 - t**k) ** b >= r and b * k <= 256
