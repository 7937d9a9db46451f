import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm.line_dedup import line_dedup
from codequarry.llm.substring_dedup import Texts, deal, parse, run_lengths, substring_dedup


def brute_windows(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def test_substrings_match_brute_force(docs, texts, crowd):
    for size, gram in ((35, 12), (6, 3), (5, 5)):
        got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(crowd(docs), min_words=size, gram=gram, bucket_bytes=2000).collect()], key=str)
        assert got == brute_windows(texts, size)


def test_substring_spans_cover_what_went(docs):
    for r in substring_dedup(docs).collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed


def words_of_blocks(df, bucket_bytes):
    """The words of each block in the order of its index."""
    out = defaultdict(list)
    for r in deal(df, "doc_id", "text", bucket_bytes).collect():
        out[r.b].append({"d": r.d, "t": bytes(r.t) if r.t is not None else None, "h": r.h})
    schema = pa.schema([("d", pa.int64()), ("t", pa.binary()), ("h", pa.int64())])
    return {b: [w for t in Texts(pa.Table.from_pylist(rows, schema)).texts for w in t.split()] for b, rows in out.items()}


@pytest.mark.parametrize("size,gram,block", [(35, 12, 2000), (6, 3, 700), (6, 3, 1 << 20)])
def test_factors_are_greedy_and_stand_where_they_say(docs, texts, size, gram, block):
    blocks = words_of_blocks(docs, block)
    by_text = defaultdict(list)
    for i, t in texts:
        by_text[i].append((t or "").encode().split())
    rows = substring_dedup(docs, min_words=size, gram=gram, bucket_bytes=block).collect()
    seen = Counter(tuple(w[i : i + size]) for ws in by_text.values() for w in ws for i in range(len(w) - size + 1))
    assert any(r.factors for r in rows)
    for r in rows:
        (w,) = {tuple(x) for x in by_text[r.doc_id] if len(x) == r.n_words}
        at = 0
        for f in r.factors:
            # No window starts between factors that stands elsewhere; the factor is its reference's words and can't go on.
            assert all(seen[w[i : i + size]] == 1 for i in range(at, f.first) if i + size <= len(w))
            there = blocks[f.block][f.word : f.word + f.words + 1]
            assert f.words >= size and tuple(there[: f.words]) == w[f.first : f.first + f.words]
            at = f.first + f.words
        gone = {j for f in r.factors for j in range(f.first, f.first + f.words)}
        inside = {j for a, b in r.spans for j in range(a, b)}
        assert gone <= inside and all(any(j in gone for j in range(a, b)) for a, b in r.spans)


def test_parse_takes_the_longest_reference_at_each_word():
    rng = random.Random(4)
    for _ in range(300):
        n, size = 40, 3
        refs = []
        for _ in range(2):
            places = np.full(n, -1, np.int64)
            for i in range(n - size + 1):
                if rng.random() < 0.6:
                    places[i] = places[i - 1] + 1 if i and places[i - 1] >= 0 and rng.random() < 0.8 else rng.randrange(1000)
            refs.append(places)
        want, i = [], 0
        while i < n:
            best = 0
            for places in refs:
                k = 0
                while i + k < n and places[i + k] >= 0 and places[i + k] == places[i] + k:
                    k += 1
                if k > best:
                    best, place = k, int(places[i])
            if best:
                want.append((i, best + size - 1, place))
                i += best + size - 1
            else:
                i += 1
        assert parse([(p, run_lengths(p)) for p in refs], size, 0, n) == want


def test_one_text_and_id_in_most_rows_is_spread_over_blocks(spark):
    rng = random.Random(12)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    hot, rows = make(60), [(i, make(50)) for i in range(30)]
    rows += [(None, hot)] * 90 + [(None, None)] * 40 + [(7, rows[3][1]), (8, "x " + hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(r["count"] for r in deal(df, "doc_id", "text", 4000).groupBy("b").count().collect()) < 60
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, bucket_bytes=4000).collect()], key=str)
    assert got == brute_windows(rows, 35)


def test_substrings_of_bytes_that_are_no_text(spark):
    text = b"\xff\xfe " + b" ".join(b"a%d" % i for i in range(40))
    df = spark.createDataFrame([(1, bytearray(text)), (2, bytearray(text[3:])), (3, bytearray(b"\xc3( b"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = {r.doc_id: (r.n_removed, bytes(r.k)) for r in substring_dedup(df).selectExpr("doc_id", "n_removed", "cast(kept_text as binary) as k").collect()}
    assert got == {1: (40, b"\xff\xfe"), 2: (40, b""), 3: (0, b"\xc3( b")}


def test_substrings_of_nothing(none):
    assert substring_dedup(none).count() == 0


def brute_lines(rows, size=3, min_words=50):
    seen, order = set(), sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    gone = {}
    for i, t in order:
        ls = t.split("\n")
        at = [n for n, x in enumerate(ls) if x.strip(" \t\n\r\x0b\f")]
        out = set()
        for k in range(len(at)):
            for few in range(1, size + 1):
                run = tuple(ls[n] for n in at[k : k + few])
                if len(run) == few and (few == size or min_words and len(" ".join(run).split()) >= min_words):
                    if run in seen:
                        out.update(at[k : k + few])
                    seen.add(run)
        gone[i, t] = out
    return sorted([(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t]) if t is not None else None, len(gone[i, t]) if t is not None else 0) for i, t in rows], key=str)


def test_lines_match_brute_force(docs, texts, crowd):
    got = sorted([(r.doc_id, r.text, r.n_removed) for r in line_dedup(crowd(docs)).collect()], key=str)
    assert got == brute_lines(texts)


@pytest.mark.parametrize("min_lines,min_words", [(3, 50), (3, None), (4, 7), (2, 5), (1, None)])
def test_runs_of_few_kinds_of_lines_match_brute_force(spark, min_lines, min_words):
    """Lines that repeat all the time, in and across texts, with ties of hashes."""
    rng = random.Random(21)
    kinds = ["a", "b b b", "c c c c c c", "d e f", "", " \t "] + [f"only {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(12)))) for i in range(60)] + [(70, "a\n" * 300), (71, "a\n" * 40), (72, None), (73, "")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=min_lines, min_words=min_words).collect()
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got], key=str) == brute_lines(rows, min_lines, min_words)


def test_lines_of_a_hot_row_and_of_bytes_that_are_no_text(spark):
    hot = "one\ntwo\nthree\nfour"
    rows = [(None, bytearray(hot.encode()))] * 60 + [(None, None)] * 40 + [(1, bytearray(b"x\n" + hot.encode())), (2, bytearray(b"\xff a\n\xfe b\nc")), (3, bytearray(b"\xff a\n\xfe b\nc\n\xff"))]
    df = spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = line_dedup(df).selectExpr("doc_id", "cast(text as binary) as text", "n_removed").collect()
    assert len(got) == len(rows) and all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert {r.doc_id: (bytes(r.text), r.n_removed) for r in got if r.doc_id} == {1: (b"x", 4), 2: (b"\xff a\n\xfe b\nc", 0), 3: ("\ufffd".encode(), 3)}


def test_one_or_two_long_lines_are_a_run(spark):
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, a, b, short = make(50), make(30), make(20), make(49)
    rows = [(1, one), (2, one), (3, f"{make(5)}\n{one}\n{short}"), (4, f"{short}\n{make(60)}"), (5, f"{a}\n \n{b}"), (6, f"{a}\n{b}"), (7, f"{a}\n{make(40)}\n{b}\n{a}\n{b}\n{make(3)}"), (8, f"{make(9)}\n{one}\n{one}"), (9, one), (9, one)]
    seen, want = set(), []
    for i, t in sorted(set(rows)):
        ls = t.split("\n")
        at = [n for n, x in enumerate(ls) if x.strip()]
        gone = set()
        for k in range(len(at)):
            for size in (1, 2, 3):
                run = tuple(ls[n] for n in at[k : k + size])
                if len(run) == size and (size == 3 or len(" ".join(run).split()) >= 50):
                    if run in seen:
                        gone.update(at[k : k + size])
                    seen.add(run)
        want += [(i, "\n".join(x for n, x in enumerate(ls) if n not in gone), len(gone))] * rows.count((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup(df).collect()) == sorted(want)
    assert sum(r.n_removed for r in line_dedup(df, min_words=None).collect()) < sum(n for _, _, n in want)


def test_lines_keep_columns_and_nothing(docs, none):
    kept = line_dedup(docs, keep=("lang", "source"))
    assert kept.select("kept.source").count() == docs.count()
    assert line_dedup(none).count() == 0


def test_lines_repeated_in_one_text(spark):
    text = "a a\nb b\nc c\n\na a\nb b\n \nc c\nd d"
    r = line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.text == "a a\nb b\nc c\n\n \nd d" and r.n_removed == 3


def test_sliding_argmin():
    from codequarry.llm.common import sliding_argmin

    g = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 24):
        assert sliding_argmin(g, w).tolist() == [i + int(np.argmin(g[i : i + w])) for i in range(len(g) - w + 1)]


def test_written_tables_can_be_dropped(spark, docs):
    from codequarry.llm import common

    t = common.materialize(docs.select("doc_id"), "t")
    assert t.count() == docs.count() and common.shared_dir(spark) in t.inputFiles()[0]
    assert common.drop_tables(spark) >= 1 and common.drop_tables(spark) == 0


def test_components_of_a_long_chain_and_a_star(spark):
    from codequarry.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 6)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_shuffled_chains(spark):
    from codequarry.llm.common import components

    rng = random.Random(2)
    ids = rng.sample(range(-(10**15), 10**15), 1300)
    chains = ids[:400], ids[400:1200], ids[1200:]
    edges = [e for c in chains for e in zip(c, c[1:])]
    rng.shuffle(edges)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(c) for c in chains for i in c}
