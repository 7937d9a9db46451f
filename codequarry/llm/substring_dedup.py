"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is dealt into blocks of documents, equal texts to one block. Every
block is a reference: its index holds, for each of its windows of min_words
words, the place where the window first stands in the block. A document is
parsed greedily from left to right. At each word the windows of the other
blocks' indexes and of its own block are looked up; if one is found, the
factor is the longest run along one of these references, and the parse goes on
behind it; else the word is a literal. Factors have min_words words at least,
so each is a duplicate span. At factor boundaries a factor's last words may
begin a window that goes on past its end: those windows are looked up too, so
no window that stands elsewhere is lost, whichever reference was followed.

Plan: one shuffle of texts by block, which all three passes read. Pass one
writes each block's distinct anchors: an anchor is the smallest hash among a
window's runs of gram words, which equal windows share wherever they stand.
Pass two indexes the windows whose anchors a second block has too. A window
then meets the blocks that index it (a row a block at most), and each block is
sent the place in the block before it or, from the first, behind it. Pass
three parses. A text that stands in thousands of rows is indexed and parsed
once a block. Anchors are 64-bit hashes and only narrow the search; windows are
told apart by 96 bits of hashes of 64-bit word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, WordHash, bucket_count, isin_sorted, materialize, rolling, sliding_argmin, table

MIN_WORDS = 35
GRAM = 12
BUCKET_BYTES = 6 << 20
CHUNK_WORDS = 1 << 18
MOST_COPIES = 1024
ROW_BYTES = 64  # what a row without text counts for
PLACE = 32  # bits of a place for the word within its block


class Texts:
    """The distinct texts of a block in a fixed order, and their rows."""

    def __init__(self, rows: pa.Table):
        texts, hashes, ids = rows["t"].to_pylist(), rows["h"].to_pylist(), rows["d"].to_pylist()
        places: dict = {}
        for h, t, d in zip(hashes, texts, ids):
            places.setdefault((h, t or b""), []).append(d)
        order = sorted(places)
        self.texts = [t for _, t in order]
        self.ids = [places[k] for k in order]

    def chunks(self, known: WordHash, most: int = CHUNK_WORDS):
        """Texts in groups of about most words: (first text, words of each, hashes of all)."""
        first, group, n = 0, [], 0
        for i, text in enumerate(self.texts):
            words = text.split()
            group.append(words)
            n += len(words)
            if n >= most:
                yield first, group, known.array([w for ws in group for w in ws])
                first, group, n = i + 1, [], 0
        if group:
            yield first, group, known.array([w for ws in group for w in ws])


def windows(group: list, h: np.ndarray, size: int, gram: int):
    """(starts of windows inside one text, anchor's index of each, all run hashes)."""
    if len(h) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    runs = rolling(h, gram)
    at = sliding_argmin(runs, size - gram + 1)
    n = np.fromiter(map(len, group), np.int64, len(group))
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))
    starts = np.flatnonzero(left[: len(at)] >= size)
    return starts, at[starts], runs


def names(h: np.ndarray, starts: np.ndarray, size: int):
    """64 and 32 bits of hash of the windows at starts."""
    if not len(starts):
        return np.empty(0, U), np.empty(0, U)
    return rolling(h, size)[starts], rolling(h, size, True)[starts] >> U(32)


def _signed(x):
    return pa.array(x.view(np.int64))


def _unsigned(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(U) if len(column) else np.empty(0, U)


def _anchors(size: int, gram: int):
    def run(key, docs):
        known, found = WordHash(), []
        for _, group, h in Texts(docs).chunks(known):
            _, at, runs = windows(group, h, size, gram)
            found.append(np.unique(runs[at]))
        v = np.unique(np.concatenate(found)) if found else np.empty(0, U)
        return pa.table({"v": _signed(v), "b": pa.array(np.full(len(v), key[0].as_py(), np.int64))})

    return run


def _indexed(size: int, gram: int):
    def run(key, docs, marks):
        known, found, before = WordHash(), [], 0
        wanted = np.sort(_unsigned(marks["v"]))
        if len(wanted):
            for _, group, h in Texts(docs).chunks(known):
                starts, at, runs = windows(group, h, size, gram)
                starts = starts[isin_sorted(runs[at], wanted)[0]]
                w1, w2 = names(h, starts, size)
                found.append((w1, w2, (starts + before).astype(U)))
                before += len(h)
        w1, w2, at = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, U),) * 3
        order = np.lexsort((at, w2, w1))
        w1, w2, at = w1[order], w2[order], at[order]
        first = np.r_[True, (np.diff(w1.view(np.int64)) != 0) | (np.diff(w2.view(np.int64)) != 0)] if len(w1) else np.empty(0, bool)
        place = (U(key[0].as_py()) << U(PLACE)) | at[first]
        return pa.table({"w1": _signed(w1[first]), "w2": pa.array(w2[first].astype(np.uint32).view(np.int32)), "at": _signed(place)})

    return run


def look_up(w1, w2, ordered1, ordered2, places) -> np.ndarray:
    """Places of the windows (w1, w2) among those ordered by (ordered1, ordered2); -1 where there is none."""
    out = np.full(len(w1), -1, np.int64)
    if not len(ordered1):
        return out
    at = np.searchsorted(ordered1, w1)
    while True:
        open_ = (out < 0) & (at < len(ordered1))
        near = np.where(open_, at, 0)
        open_ &= ordered1[near] == w1
        hit = open_ & (ordered2[near] == w2)
        out[hit] = places[near[hit]]
        at = at + 1
        if not (open_ & ~hit).any():
            return out


def run_lengths(places: np.ndarray) -> np.ndarray:
    """Of each window, how many windows from it on stand one after another in the reference too (0 without a place)."""
    n = len(places)
    if not n:
        return np.empty(0, np.int64)
    last = np.r_[(places[:-1] < 0) | (places[1:] != places[:-1] + 1), True]
    end = np.where(last, np.arange(n), n)
    end = np.minimum.accumulate(end[::-1])[::-1]
    return np.where(places >= 0, end - np.arange(n) + 1, 0)


def parse(references: list, size: int, first: int, end: int) -> list:
    """Greedy factors (first word, words, place) of the words from first to end.

    references are arrays of places by window start, and run_lengths of them.
    Only starts at which one has a place are visited.
    """
    longest = np.max([n[first:end] for _, n in references], 0)
    which = np.argmax([n[first:end] for _, n in references], 0)
    starts = np.flatnonzero(longest)
    out, at = [], 0
    while at < len(starts):
        i = int(starts[at])
        words = int(longest[i]) + size - 1
        out.append((i, words, int(references[which[i]][0][first + i])))
        at = int(np.searchsorted(starts, i + words))
    return out


def covered(factors: list, found: np.ndarray, size: int) -> np.ndarray:
    """Which words of a text go: those of factors, and of windows found at factor boundaries."""
    n = len(found)
    edge = np.zeros(n + size + 1, np.int32)
    for i, words, _ in factors:
        edge[i] += 1
        edge[i + words] -= 1
        straddling = i + words - size + 1 + np.flatnonzero(found[i + words - size + 1 : i + words])
        np.add.at(edge, straddling, 1)
        np.add.at(edge, straddling + size, -1)
    return np.cumsum(edge)[:n] > 0


FACTORS = "array<struct<first:bigint,words:bigint,block:bigint,word:bigint>>"


def _parse(size: int, gram: int):
    factor = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("block", pa.int64()), ("word", pa.int64())])
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())]
    out = pa.schema([*kinds, ("spans", pa.list_(pa.list_(pa.int64()))), ("factors", pa.list_(factor))])

    def run(key, docs, marks):
        known, texts = WordHash(), Texts(docs)
        block = (key if len(docs) else [pa.scalar(0)])[0].as_py()
        m1, m2, src = _unsigned(marks["w1"]), _unsigned(marks["w2"]) & U(0xFFFFFFFF), _unsigned(marks["src"]).view(np.int64)
        order = np.lexsort((m2, m1))
        m1, m2, src = m1[order], m2[order], src[order]
        parts, before = [], 0
        for first, group, h in texts.chunks(known):
            starts, at, runs = windows(group, h, size, gram)
            parts.append((first, group, len(h), before, starts, at, runs[at], *names(h, starts, size)))
            before += len(h)
        # Windows that stand twice in this block: looked for among anchors that do.
        seen = np.sort(np.concatenate([v[np.r_[True, np.diff(at) != 0]] if len(at) else v for *_, at, v, _, _ in parts])) if parts else np.empty(0, U)
        twice = np.unique(seen[1:][seen[1:] == seen[:-1]])
        own = [isin_sorted(v, twice)[0] for *_, v, _, _ in parts]
        w1 = np.concatenate([p[7][k] for p, k in zip(parts, own)]) if parts else seen[:0]
        w2 = np.concatenate([p[8][k] for p, k in zip(parts, own)]) if parts else seen[:0]
        at = np.concatenate([p[4][k] + p[3] for p, k in zip(parts, own)]) if parts else np.empty(0, np.int64)
        order = np.lexsort((at, w2, w1))
        same = (np.diff(w1[order].view(np.int64)) == 0) & (np.diff(w2[order].view(np.int64)) == 0)
        back, ahead = np.r_[False, same][: len(order)], np.r_[same, False][: len(order)]
        other = np.full(len(order), -1, np.int64)
        other[order[back]] = at[order[np.flatnonzero(back) - 1]]
        alone = ahead & ~back
        other[order[alone]] = at[order[np.flatnonzero(alone) + 1]]
        rows, done = [], 0
        for (first, group, n_words, base, starts, _, v, a, b), mine in zip(parts, own):
            away = np.full(n_words, -1, np.int64)
            away[starts] = look_up(a, b, m1, m2, src)
            here = np.full(n_words, -1, np.int64)
            k = int(mine.sum())
            here[starts[mine]] = np.where(other[done : done + k] >= 0, other[done : done + k] + (block << PLACE), -1)
            done += k
            repeated = np.repeat([len(texts.ids[first + i]) > 1 for i in range(len(group))], [len(ws) for ws in group])
            again = starts[repeated[starts] & (here[starts] < 0)] if len(starts) else starts
            here[again] = again + base + (block << PLACE)  # the same place of another row with this text
            references = [(away, run_lengths(away)), (here, run_lengths(here))]
            lo = 0
            for i, words in enumerate(group):
                n, hi = len(words), lo + len(words)
                factors = parse(references, size, lo, hi)
                spans, cut, kept = [], 0, words
                if factors:
                    gone = covered(factors, (away[lo:hi] >= 0) | (here[lo:hi] >= 0), size)
                    cut = int(gone.sum())
                    spans = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
                    kept = [words[j] for j in np.flatnonzero(~gone)]
                    factors = [{"first": f, "words": w, "block": p >> PLACE, "word": p & ((1 << PLACE) - 1)} for f, w, p in factors]
                text = b" ".join(kept)
                rows += [(d, n, cut, text, spans, factors) for d in texts.ids[first + i]]
                lo = hi
        columns = list(zip(*rows)) or [[]] * len(out)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return run


def deal(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """(d, t, h, b): rows dealt by text; those of a text that fills half a block, or stands in MOST_COPIES rows, also by row."""
    n = bucket_count(docs, text_col, bucket_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    size = F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + ROW_BYTES)
    splits = F.greatest(F.ceil(2 * size / bucket_bytes), F.ceil(F.count("*") / MOST_COPIES))
    hot = materialize(rows.groupBy("h").agg(splits.alias("splits")).where("splits > 1"), "hot")
    place = lambda salt: F.pmod(F.xxhash64("h", salt), F.lit(n)).alias("b")
    if hot.isEmpty():
        return rows.select("d", "t", "h", place(F.lit(0).cast("long")))
    # Written, so that a row keeps its block however often the rows are read.
    spread = rows.withColumn("o", F.monotonically_increasing_id()).join(hot, "h", "left")
    return materialize(spread.select("d", "t", "h", place(F.pmod("o", F.coalesce("splits", F.lit(1))))), "dealt")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Remove every word in a run of min_words words that also starts elsewhere.

    Returns a row per input row: doc_id, n_words, n_removed, kept_text (kept
    words joined by one space), spans ([first, end) word positions of what
    went) and factors (first word, words, and the block and word of the
    reference; which of several references is followed is not fixed by the
    contents alone, what goes is). Words are runs without ASCII white space,
    kept as they are, also where they are no valid UTF-8. Null or empty text: no
    words, empty kept_text. Repeated rows are documents of their own, so their
    long passages go from both. Ids are cast to long (an id that is no integer
    fails); a null id is carried along. A text of any length is parsed in one
    task. Other columns are ignored, whatever their names. An empty table gives
    an empty result. gram must not exceed min_words.
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be from 1 to min_words")
    by = deal(docs, id_col, text_col, bucket_bytes).groupBy("b")
    anchors = materialize(by.applyInArrow(_anchors(min_words, gram), "v long, b long"), "anchors")
    often = anchors.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    index = by.cogroup(anchors.join(often, "v").groupBy("b")).applyInArrow(_indexed(min_words, gram), "w1 long, w2 int, at long")
    order = Window.partitionBy("w1", "w2").orderBy("at")
    place = F.coalesce(F.lag("at").over(order), F.lead("at").over(order))
    found = index.withColumn("src", place).where("src is not null").select("w1", "w2", "src", F.shiftright("at", PLACE).alias("b"))
    kinds = f"doc_id long, n_words long, n_removed long, kept_text binary, spans array<array<long>>, factors {FACTORS}"
    out = by.cogroup(found.groupBy("b")).applyInArrow(_parse(min_words, gram), kinds)
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def op1_substring_dedup(spark, sf_dir):
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM d, range(35) AS t(o)),
kept AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.pos) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) a
  LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos WHERE g.pos IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
