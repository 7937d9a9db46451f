"""Benchmark decontamination by greedy string tiling.

Seeds are runs of min_match words that a document shares with a benchmark item
(an item of fewer words is one seed as a whole). They are joined in Spark on
the runs' hashes. Each pair of a document and an item is then tiled: of the
words not yet marked, the longest match is found by running Karp-Rabin (hashes
of runs of seeds, the length by bisection, as every part of a match is a match)
and marked on both sides, and so on until no seed is left. The share of an
item's words that are marked is its coverage, however its passages are ordered.

Plan: one scan of the texts, without a shuffle, in which a bitmap of the items'
seed hashes (at most FILTER_BITS bits, whatever the benchmark's size) drops what
no item has. Only the seeds left are shuffled, each with its places in one text:
by hash to meet the items, then by document and item. An item's most frequent seeds
make no pair as long as they cover less of it than the threshold: whatever gives
the item away shares one of its other seeds too. So pairs come from those alone,
and the rest of a pair's seeds is fetched for the pairs there are. Rows are as
long as a document's or an item's own seeds. Items of equal words are one item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_A_BATCH, U, WordHash, few, flags, kept, low_bits, materialize, mix, rolling, table, words_of

MIN_MATCH = 5
COVERAGE = 0.5
FILTER_BITS = 1 << 26
CHUNK_WORDS = 1 << 17


def seeds_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words of h; runs of other sizes have other hashes."""
    return mix(rolling(h, size) + U(size))


def longest_run(at: np.ndarray) -> int:
    """How many neighbours of the ascending at follow one another by 1, at most."""
    if not len(at):
        return 0
    edges = np.flatnonzero(np.r_[True, np.diff(at) != 1, True])
    return int(np.diff(edges).max())


def tiles(doc_at, doc_seed, item_at, item_seed, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, words) of one pair.

    The places of seeds of k words, ascending, and the seeds, by number. Of
    equally long matches the first in the document is taken, then in the item.
    """
    doc_at, item_at = np.asarray(doc_at, np.int64), np.asarray(item_at, np.int64)
    doc_seed, item_seed = np.asarray(doc_seed, U), np.asarray(item_seed, U)
    out = []

    def common(r):
        """Where runs of r seeds begin that both have, and their hashes."""
        runs = []
        for at, seed in ((doc_at, doc_seed), (item_at, item_seed)):
            first = np.flatnonzero(at[r - 1 :] - at[: len(at) - r + 1] == r - 1)
            runs.append((first, rolling(seed, r)[first]))
        (d, hd), (i, hi) = runs
        here = np.isin(hd, hi)
        return (d[here], hd[here], i, hi) if here.any() else None

    while top := min(longest_run(doc_at), longest_run(item_at)):
        low, found, r = 0, None, top
        while low < r:
            got = common(r)
            if got:
                low, found = r, got
            else:
                top = r - 1
            r = (low + top + 1) // 2
        if not found:
            break
        d, hd, i, hi = found
        p, q, n = int(doc_at[d[0]]), int(item_at[i[np.flatnonzero(hi == hd[0])[0]]]), low + k - 1
        out.append((p, q, n))
        free = (doc_at <= p - k) | (doc_at >= p + n)
        doc_at, doc_seed = doc_at[free], doc_seed[free]
        free = (item_at <= q - k) | (item_at >= q + n)
        item_at, item_seed = item_at[free], item_seed[free]
    return out


def _item_seeds(k: int):
    def run(batches):
        known = WordHash()
        for batch in batches:
            out = ([], [], [], [], [])
            for item, text in zip(batch.column("i").to_pylist(), batch.column("x").to_pylist()):
                h = known.array(words_of(text))
                if not len(h):
                    continue
                size = min(k, len(h))
                seeds = seeds_of(h, size)
                name = int(rolling(h, len(h)).view(np.int64)[0] ^ np.int64(len(h)))
                for column, values in zip(out, ([item] * len(seeds), [name] * len(seeds), [len(h)] * len(seeds), range(len(seeds)), seeds.view(np.int64).tolist())):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["i", "name", "n", "q", "g"])

    return run


def _doc_seeds(sizes: list[int], bitmap: np.ndarray):
    def hits(group, ids, hashes, known, maybe):
        mask = U(len(maybe) - 1)
        h = known.array([w for ws in group for w in ws])
        ends = np.cumsum([len(ws) for ws in group])
        begins = np.r_[0, ends[:-1]]
        for size in sizes:
            seeds = seeds_of(h, size) if len(h) >= size else h[:0]
            at = np.flatnonzero(maybe[(seeds & mask).astype(np.int64)])
            doc = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[doc]
            at, doc = at[inside], doc[inside]
            if len(at):
                which = pa.array(doc)
                yield pa.RecordBatch.from_arrays([ids.take(which), hashes.take(which), pa.array(at - begins[doc]), pa.array(seeds[at].view(np.int64))], names=["d", "h", "p", "g"])

    def run(batches):
        known, maybe = WordHash(), flags(bitmap)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            first, group, n = 0, [], 0
            for i, text in enumerate([*texts, None]):
                if n >= CHUNK_WORDS or i == len(texts):
                    if n:
                        yield from hits(group, batch.column("d")[first:i], batch.column("h")[first:i], known, maybe)
                    first, group, n = i, [], 0
                group.append(words_of(text))
                n += len(group[-1])

    return run


def deciding(n: int, size: int, seeds: list[tuple[int, int, list[int]]], coverage: float) -> list[int]:
    """Seeds of an item of n words without which no document covers the share: all but the most frequent ones that together cover less.

    seeds: (documents, seed, places) of those that any document has.
    """
    covered, words, out = np.zeros(n, bool), 0, []
    for _, seed, places in sorted(seeds, key=lambda x: (-x[0], x[1])):
        more = {w for q in places for w in range(q, q + size) if not covered[w]}
        if (words + len(more)) / n < coverage:
            covered[list(more)] = True
            words += len(more)
        else:
            out.append(seed)
    return out


def _deciding(k: int, coverage: float):
    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for name, n, seeds in zip(*[batch.column(c).to_pylist() for c in ("name", "n", "seeds")]):
                for g in deciding(n, min(k, n), [(x["docs"], x["g"], x["qs"]) for x in seeds], coverage):
                    for column, value in zip(out, (name, n, g)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["name", "n", "g"])

    return run


def candidates(seeds: DataFrame, sought: DataFrame, k: int, coverage: float) -> DataFrame:
    """(d, h, name, n) of the documents and items that share a seed which decides: from seeds (d, h, g) and sought (name, n, g, qs)."""
    docs = seeds.groupBy("g").agg(F.count("*").alias("docs"))
    items = sought.join(docs, "g").groupBy("name", "n").agg(F.collect_list(F.struct("docs", "g", "qs")).alias("seeds"))
    rare = materialize(items.mapInArrow(_deciding(k, coverage), "name long, n long, g long"), "deciding")
    return seeds.select("d", "h", "g").join(rare, "g").select("d", "h", "name", "n").distinct()


def _tile(k: int, coverage: float):
    def run(batches):
        kind = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            out = []
            for n, pairs in zip(batch.column("n").to_pylist(), batch.column("seeds").to_pylist()):
                size = min(k, n)
                sides = []
                for side in ("ps", "qs"):
                    at = np.fromiter((x for pair in pairs for x in pair[side]), np.int64)
                    seed = np.repeat(np.arange(len(pairs)), [len(pair[side]) for pair in pairs])
                    order = np.argsort(at, kind="stable")
                    sides += [at[order], seed[order]]
                # Words of the item in any seed: no tiling marks more.
                at = sides[2]
                most = int(np.minimum(np.diff(np.r_[at, at[-1:] + size]), size).sum())
                out.append([list(t) for t in tiles(*sides, size)] if most >= coverage * n else [])
            marked = pa.array([sum(t[2] for t in ts) for ts in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "h", "name", "n")] + [marked, pa.array(out, kind)], names=["d", "h", "name", "n", "marked", "tiles"])

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", min_match=MIN_MATCH, coverage=COVERAGE, filter_bits=FILTER_BITS
) -> DataFrame:
    """(d, h, best_coverage, hits) of the documents that give items away: by id and xxhash64 of the text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("binary").alias("x"))
    grams = items.mapInArrow(_item_seeds(min_match), "i long, name long, n long, q long, g long")
    # Of items of equal words the smallest id speaks for all; the seeds of one stay.
    grams = grams.groupBy("name", "n", "q", "g").agg(F.min("i").alias("item_id"), F.count("*").alias("n_items"))
    n_items, n_docs = items.count(), docs.count()
    grams = materialize(few(grams, n_items), "item-seeds")
    sizes = sorted(r["size"] for r in grams.select(F.least("n", F.lit(min_match)).cast("int").alias("size")).distinct().collect())
    bitmap = low_bits(grams, "g", grams.count(), filter_bits)
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("binary").alias("t"))
    seeds = texts.withColumn("h", F.xxhash64("t")).mapInArrow(_doc_seeds(sizes, bitmap), "d long, h long, p long, g long")
    seeds = materialize(few(seeds.groupBy("d", "h", "g").agg(F.collect_set("p").alias("ps")), n_docs), "seeds", TEXTS_A_BATCH)
    sought = materialize(few(grams.groupBy("name", "n", "g").agg(F.collect_list("q").alias("qs")), n_items), "sought")
    wanted = candidates(seeds, sought, min_match, coverage).join(sought, ["name", "n"]).alias("w")
    same = F.col("w.d").eqNullSafe(F.col("s.d")) & (F.col("w.h") == F.col("s.h")) & (F.col("w.g") == F.col("s.g"))
    both = wanted.join(seeds.alias("s"), same).select("w.d", "w.h", "name", "n", "ps", "qs")
    pairs = both.groupBy("d", "h", "name", "n").agg(F.collect_list(F.struct("ps", "qs")).alias("seeds"))
    tiled = pairs.mapInArrow(_tile(min_match, coverage), "d long, h long, name long, n long, marked long, tiles array<array<long>>")
    known = grams.where("q = 0").select("name", "n", "item_id", "n_items")
    hit = tiled.withColumn("coverage", F.col("marked") / F.col("n")).where(F.col("coverage") >= coverage).join(known, ["name", "n"])
    hits = F.array_sort(F.collect_list(F.struct("item_id", "n_items", "coverage", "tiles")))
    return materialize(few(hit.groupBy("d", "h").agg(F.max("coverage").alias("best_coverage"), hits.alias("hits")), n_docs), "leaks")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, filter_bits: int = FILTER_BITS, keep: tuple = (),
) -> DataFrame:
    """Which benchmark items each document gives away.

    Returns a row per input row: doc_id, text, contaminated, best_coverage and
    hits (item_id, n_items, coverage, tiles as [document word, item word,
    words]) of the items whose coverage is at least the threshold; without one,
    0 and null. Items of equal words are one hit, with the smallest id and their
    number. An item of fewer than min_match words is found where it stands
    whole. Null and empty texts, and texts without words, have no hits, on
    either side. Repeated rows each get their result. Ids are cast to long (an
    id that is no integer fails); null ids are carried, and an item with a null
    id counts. Of equally long matches the first in the document is marked
    first, then the first in the item. Texts are read as bytes, so they need not
    be valid UTF-8; a text of any length is one row of the scan. Columns named
    in keep come back as the struct kept; others are ignored, whatever their
    names. Empty tables give no rows, or no hits.
    """
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, min_match, coverage, filter_bits).alias("r")
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), kept(docs, keep).alias("kept")).withColumn("h", F.xxhash64(F.col("t").cast("binary")))
    out = base.alias("l").join(found, F.col("l.d").eqNullSafe(F.col("r.d")) & (F.col("l.h") == F.col("r.h")), "left")
    return out.select(
        F.col("l.d").alias("doc_id"), F.col("l.t").alias("text"), F.col("r.hits").isNotNull().alias("contaminated"),
        F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"), "hits", *([F.col("l.kept")] if keep else []),
    )


def op7_decontaminate(spark, sf_dir):
    """The documents that give items away, with the items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")
    return found.select("doc_id", "contaminated", F.round("best_coverage", 6).alias("best_coverage"), F.array_sort(F.transform("hits", lambda x: x["item_id"])).alias("items"))
