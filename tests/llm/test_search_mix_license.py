import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codequarry.llm.license_scan import BASE, WORD, license_scan
from codequarry.llm.source_mixing import mix_sources
from codequarry.llm.topk_search import SlicedBlock, digits, topk_search


def test_digits_rebuild_the_number():
    for n in range(300):
        assert sum((-1 if neg else 1) << at for at, neg in digits(n)) == n


@pytest.mark.parametrize("dropped", [0, 2, 4, 9])
def test_sliced_block_is_exact(dropped):
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (300, 8))
    x[40:80] = x[40]  # ties
    ids = rng.permutation(1000)[:300]
    block = SlicedBlock(ids, x, dropped)
    for n in range(20):
        q = rng.integers(-500, 500, 8)
        got, scores = block.search(q, 10, int(ids[n]))
        want = sorted(((int(-(x[i] @ q)), int(ids[i])) for i in range(300) if i != n))[:10]
        assert [(-int(s), int(i)) for i, s in zip(got, scores)] == want


def test_search_edges(spark, crowd):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(50)] + [(50, None), (51, [0.1, None, 0.2, 0.3]), (52, [float("nan"), 0.0, 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0, 0.0]), (54, []), (60, []), (56, []), (None, [0.5] * 4), (55, [0.5, 0.5]), (7, [0.9] * 4)]
    df = crowd(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk_search(df, df.where("vec_id % 10 = 0"), block_numbers=28, queries_a_task=2)
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)
    assert topk_search(df.where("false"), df.where("false")).count() == 0
    assert topk_search(df.where("vec_id < 4"), df.where("vec_id = 0")).count() == 3


def test_search_takes_all_lengths_and_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 5]) for _ in range(2 + i % 3)]) for i in range(60)] + [(60 + i, [rng.uniform(-1, 1) * 1e5, -2.5e6 - i]) for i in range(5)]
    rows += [(70, [1e7, 2.0, 3.0, 4.0]), (0, [0.5, 0.25, 1.0]), (0, [-0.5, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search(df, df.where("vec_id % 5 = 0"), block_numbers=28, queries_a_task=2)
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 5 == 0}):
        v = min(v for i, v in ints if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)
    huge = spark.createDataFrame([(1, [1e8]), (2, [1e15])], "vec_id long, embedding array<double>")
    for late in (huge, spark.createDataFrame([(1, [1.0]), (2, [1e300])], huge.schema)):
        with pytest.raises(Exception, match="does not fit"):
            topk_search(late, late.where("vec_id = 1")).collect()


def test_an_index_reads_back_and_a_hot_id_is_spread(spark):
    rng = np.random.default_rng(4)
    for most in (3, 40_000, 2**40):
        x = rng.integers(-most, most, (130, 5))
        block = SlicedBlock(np.arange(130), x)
        again = SlicedBlock.read(block.row(), block.dropped)
        for q in x[:5] % 1000:
            assert [a.tolist() for a in again.search(q, 7, 3)] == [a.tolist() for a in block.search(q, 7, 3)]
    rows = [(5, [1.0, 0.5])] * 200 + [(i, [0.1 * (i % 7), 1.0]) for i in range(6, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk_search(df, df.where("vec_id = 39"), block_numbers=30).orderBy("rank").collect()]
    q = [int(np.floor(1024 * x)) for x in rows[-1][1]]
    want = sorted((-sum(a * int(np.floor(1024 * b)) for a, b in zip(q, v)), i) for i, v in rows if i != 39)[:10]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_mix_takes_exact_budgets(docs, texts, crowd, none):
    rows = mix_sources(crowd(docs)).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(taken[s] == int(target[s]) and target[s] <= 2 * sizes[s] for s in sizes)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    free = [(target[s] / (3, 1, 2)[i % 3]) for i, s in enumerate(order) if target[s] < 2 * sizes[s]]
    assert max(free) - min(free) < 1e-6
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert mix_sources(none).count() == 0


def test_a_hot_row_is_one_key_of_the_mix(spark):
    """A third of all rows are one row: they get equal parts, and the source comes near its target."""
    rows = [(None, "a b c d e f g", "s1")] * 400 + [(i, "x " * (i % 9), ["s1", "s2", None][i % 3]) for i in range(300)] + [(400, None, "empty"), (None, None, None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    hot = {r.taken for r in got if r.doc_id is None and r.size}
    assert len(got) == len(rows) and len(hot) == 1
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert 0 <= int(own[0].target) - sum(r.taken for r in own) < (400 if s == "s1" else 1) and all(r.taken <= 2 * r.size for r in own)


def test_licenses(spark, crowd, none):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "MIT LICENSE cc-by cc by"), (3, None), (4, ""), (5, "GNU General Public Licence"), (6, "x " * 3000 + "gnu general public license"), (2, "MIT LICENSE cc-by cc by"), (None, "mit license"), (7, "Ünder under cc by nc 4 0"), (8, "this work is licensed under gnu general public license version 3")]
    got = license_scan(crowd(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].base_labels, by[1].labels, by[1].n_base, by[1].first_word, by[1].score) == ("apache", "apache", 1, 3, 1.0)
    assert (by[2].base_labels, by[2].n_base, by[2].first_word, by[2].last_word, by[2].n_words) == ("cc-by,mit", 3, 0, 4, 6)
    assert (by[3].n_words, by[3].n_base, by[3].first_word, by[3].labels, by[3].score) == (0, 0, None, "", 0.0)
    assert by[5].base_labels == "" and by[6].first_word == 3000 and by[None].base_labels == "mit"
    assert "cc-by-nc" in by[7].labels and "gpl" in by[8].labels
    assert license_scan(none).count() == 0


def test_a_license_stays_found_beside_more_words_of_it(spark):
    """Neighbours don't chain: what follows a license doesn't take its label away, and the score is that of a held span."""
    agpl = "gnu affero general public license"
    rows = [(1, agpl), (2, agpl + " public license" * 6), (3, "public license " * 8), (4, ("x " * 3).join(agpl.split())), (5, (agpl + " z ") * 50), (6, "permission is granted free of charge to any person obtaining one copy of this software"), (7, "permission is given")]
    by = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("agpl" in by[i].labels.split(",") and by[i].score == 1.0 for i in (1, 2, 5))
    assert (by[3].labels, by[3].score, by[4].score, by[7].score, by[7].spans) == ("", 0.0, 0.0, 0.0, [])
    assert by[6].labels == "mit" and 0.7 <= by[6].score < 1
    assert [(s.first, s.end) for s in by[1].spans if s.label == "agpl"] == [(0, 5)] and sum(s.label == "agpl" for s in by[5].spans) == 50
    assert all(s.end - s.first <= 40 for r in by.values() for s in r.spans)


def test_license_words_are_what_the_pattern_finds(spark):
    rng = random.Random(7)
    alphabet = "aZ09 .,-_\t\n\x00\x7f\u00e9\u00df\u4e2d'\\\"$^[]"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(200)] + [(None, None), ("odd", "")]
    df = spark.createDataFrame([(None if i is None else str(i), t) for i, t in rows], "doc_id string, text string")
    got = {r.doc_id: r.n_words for r in license_scan(df).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == {None if i is None else str(i): len(re.findall(WORD, (t or "").translate(lower))) for i, t in rows}
    odd = spark.createDataFrame([(1, bytearray(b"\xff mit license \xfe")), (1, bytearray(b"\xff mit license \xfe"))], "doc_id long, raw binary")
    assert [(r.base_labels, r.first_word) for r in license_scan(odd.selectExpr("doc_id", "cast(raw as string) as text")).collect()] == [("mit", 1)] * 2


def test_license_base_matches_brute_force(spark):
    rng = random.Random(4)
    words = "gnu general public license apache cc by mit x".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(200)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        at = [(n, label) for phrase, label in BASE for n in range(len(w)) if w[n : n + len(phrase.split())] == phrase.split()]
        assert got[i].n_base == len(at) and got[i].base_labels == ",".join(sorted({x for _, x in at}))
        assert got[i].first_word == min((n for n, _ in at), default=None) and got[i].last_word == max((n for n, _ in at), default=None)


def test_license_time_is_linear_in_the_words_of_a_text(spark):
    import time

    rng = random.Random(3)
    took = {}
    for n in (50_000, 50_000, 1_000_000):  # the first one compiles
        words = [rng.choice(["mit", "license", "word", "other", "thing", "gnu"]) for _ in range(n)]
        df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        began = time.time()
        row = license_scan(df).first()
        took[n] = time.time() - began
        starts = [i for i in range(n - 1) if words[i : i + 2] == ["mit", "license"]]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n, len(starts), starts[0], starts[-1])
    assert took[1_000_000] < 20 * took[50_000]


def test_license_templates_of_any_length(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(500)}" for _ in range(2000)]
    changed = [w if rng.random() > 0.02 else "other" for w in long]
    docs = [(1, " ".join(["x"] * 5 + long)), (2, " ".join(changed)), (3, " ".join(long[:900])), (4, " ".join(long[:1000] + ["added"] + long[1000:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan(df, templates=[(" ".join(long), "long")], base=[("mit license", "mit")]).collect()}
    assert [rows[i].labels for i in (1, 2, 3, 4)] == ["long", "long", "", "long"]
    assert rows[1].score == 1.0 and 0.9 < rows[2].score < 1 and rows[4].score > 0.99


def test_topk_by_rows_that_repeat_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.9, 0.0]), (1, [0.5, 0.0]), (2, [0.1, 0.0]), (None, [9.0, 9.0]), (200, [1.0]), (3, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search(df, "vec_id % 100 = 0", k=3).collect()))
    scaled = {1.0: 1024, 0.9: 921, 0.5: 512, 0.1: 102}
    one = [(100, r, i, scaled[1.0] * scaled[x]) for r, (i, x) in enumerate([(100, 0.9), (1, 0.5), (2, 0.1)], 1)]
    two = [(100, r, i, scaled[0.9] * scaled[x]) for r, (i, x) in enumerate([(100, 1.0), (1, 0.5), (2, 0.1)], 1)]
    assert got == sorted([*one, *two, (200, 1, 3, 1024 * 2048)])
    assert sorted(map(tuple, topk_search(df, "vec_id % 100 = 0", k=3, block_numbers=2, queries_a_task=1).collect())) == got
