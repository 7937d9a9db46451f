"""N-gram Jaccard join by MinHash banding.

A text is its set of five-word shingles (words lower-cased in A-Z, split at
ASCII punctuation). Rows with equal sets are one class from the start and are
never expanded. Classes are dealt by band hashes; rows and bands follow from
the threshold and the target recall. Classes that share a band hash are tied to
the smallest of them, and the ties' components hold every candidate pair. All
pairs of a component are verified on the full sets, whatever its size: in one
task when small, else as pairs of blocks of bounded size. Tasks count links and
return one row a class, so pairs of a large group are never emitted or stored.
The work of a component grows with the square of its distinct sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_A_BATCH, TEXTS_A_TASK, U, WordHash, components, few, flags, low_bits, materialize, mix, rolling, table, words_of

SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
BLOCK, MOST_BLOCK = 128, 1024
NODES_A_TASK = 2048
FILTER_BITS = 1 << 26


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which enough bands for the recall fit."""
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def shingles(words: list, known: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    h = known.array(words)
    return np.unique(rolling(h, min(size, len(h)))) if len(h) else h


def class_of(s: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(s.tobytes())
    a, b = np.frombuffer(digest, np.int64)
    return int(a), int(b)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.a = rng.integers(0, 1 << 63, n, dtype=U) * U(2) + U(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=U)
        self.shape = bands, rows
        self.power = rng.integers(0, 1 << 63, rows, dtype=U) * U(2) + U(1)

    def bands(self, s: np.ndarray) -> np.ndarray:
        low = None
        for i in range(0, len(s), 512):
            part = (s[i : i + 512, None] * self.a + self.b).min(0)
            low = part if low is None else np.minimum(low, part)
        sums = (mix(low).reshape(self.shape) * self.power).sum(1, dtype=U)
        return mix(sums ^ (np.arange(self.shape[0]).astype(U) * U(0x9E3779B97F4A7C15)))


def _signatures(size, bands, rows):
    def run(batches):
        known, hashes = WordHash(), MinHash(bands, rows)
        for batch in batches:
            c1, c2, n, out = [], [], [], []
            for text in batch.column("t").to_pylist():
                s = shingles(words_of(text), known, size)
                a, b = class_of(s)
                c1.append(a)
                c2.append(b)
                n.append(len(s))
                out.append(hashes.bands(s).view(np.int64) if len(s) else None)
            made = [pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), *made], names=["d", "h", "c1", "c2", "n", "bands"])

    return run


def _sets(size):
    def run(batches):
        known = WordHash()
        for batch in batches:
            sets = pa.array([shingles(words_of(t), known, size).tobytes() for t in batch.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("size"), sets], names=["node", "label", "size", "s"])

    return run


def _let_pass(bitmap):
    def run(batches):
        maybe = flags(bitmap)
        mask = np.int64(len(maybe) - 1)
        for batch in batches:
            yield batch.filter(pa.array(maybe[batch.column("h").to_numpy() & mask]))

    return run


def intersections(sets: list) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, (int(col[-1]) + 1) if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((n, min(4096, int(col[b - 1]) + 1 - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def links(sets: list, threshold: float) -> np.ndarray:
    """Matrix of which pairs reach the threshold; a set is not linked to itself."""
    n = np.array([len(s) for s in sets], np.float64)
    inter = intersections(sets).astype(np.float64)
    out = inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name in the component of each row."""
    label = names.copy()
    while True:
        near = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _verify(threshold):
    def run(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        unit, node, blk = (rows[c].to_numpy() for c in ("unit", "node", "blk"))
        out = ([], [], [])
        order = np.lexsort((node, unit))
        edge = np.flatnonzero(np.r_[True, np.diff(unit[order]) != 0, True])
        sets = rows["s"]
        for lo, hi in zip(edge[:-1], edge[1:]):
            at = order[lo:hi]
            names = node[at]
            linked = links([np.frombuffer(sets[int(x)].as_py(), U) for x in at], threshold)
            if i != j:
                linked &= blk[at][:, None] != blk[at][None, :]
            out[0].append(names)
            out[1].append(linked.sum(1))
            out[2].append(roots(linked, names))
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["node", "links", "root"])

    return run


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """Classes of near-duplicate texts.

    Returns a row per input row: doc_id, class_id (the smallest doc_id in its
    component of links), n_links (other distinct shingle sets of Jaccard
    similarity threshold or more among the candidates), n_copies (rows with the
    same set, itself counted), set_id, class_set (the class's own name, null for
    texts without a set) and text_hash (xxhash64). Texts of fewer words than a
    shingle are one shingle. Null texts, empty ones and those without words have
    no set: each is a class of its own, with no links and one copy. Rows that
    repeat an id and text are copies. Ids are cast to long (an id that is no
    integer fails). Null ids never name a class that has other ids; a class of
    null ids only has a null class_id. Of equal smallest ids, class_id is that
    id. Texts are read as bytes, so they need not be valid UTF-8; a text of any
    length is one set, held in one task. Extra columns are ignored. An empty
    table gives an empty result. Sets are told apart by 128 bits, and named by 64.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n_bands, n_rows = banding(threshold, recall)
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    signed = base.mapInArrow(_signatures(size, n_bands, n_rows), "d long, h long, c1 long, c2 long, n int, bands array<long>")
    signed = materialize(signed, "signatures", TEXTS_A_BATCH)
    made = [F.min("d").alias("rep"), F.min(F.struct("h", "d")).alias("text"), F.count("*").alias("copies"), F.first("bands").alias("bands")]
    n_docs = signed.count()
    sets = materialize(few(signed.where("n > 0").groupBy("c1", "c2").agg(*made), n_docs), "sets").withColumnRenamed("c1", "node")
    dealt = materialize(sets.select("node", F.explode("bands").alias("key")), "dealt")
    leaders = dealt.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    ties = dealt.join(materialize(few(leaders, n_docs), "leaders"), "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    comps = components(ties, n_docs)
    sizes = comps.groupBy("label").agg(F.count("*").alias("size"))
    chosen = comps.join(sizes, "label").withColumnRenamed("id", "node").join(sets, "node").select("node", "text", "label", "size")
    chosen = materialize(few(chosen, n_docs), "chosen")
    total = chosen.count()

    # One text of each chosen set becomes a set again where it is needed. A bitmap of the chosen texts' hashes drops
    # most others in the scan, so they are not shuffled; rows that repeat a text are folded before they are sent.
    bitmap = low_bits(chosen.select(F.col("text.h").alias("h")), "h", total, FILTER_BITS)
    near = base.mapInArrow(_let_pass(bitmap), "d long, t binary, h long").alias("base")
    texts = near.join(chosen, (F.col("base.h") == chosen["text.h"]) & F.col("base.d").eqNullSafe(chosen["text.d"])).groupBy("node", "label", "size").agg(F.min("t").alias("t"))
    units = texts.mapInArrow(_sets(size), "node long, label long, size long, s binary").withColumnRenamed("label", "unit")
    side = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(block), F.ceil(F.col("size") / 24)))
    units = units.withColumn("blocks", F.ceil(F.col("size") / side)).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    n_tasks = max(3 * parts, -(-total // NODES_A_TASK))
    whole = F.col("blocks") == 1
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = units.select("unit", "node", "s", "blk", whole.alias("whole"), other.alias("o"))
    group = F.when(F.col("whole"), F.pmod(F.xxhash64("unit"), F.lit(n_tasks))).otherwise(F.col("unit"))
    pair = lambda of: F.when(F.col("whole"), F.lit(-1)).otherwise(of("blk", "o"))
    units = units.select("unit", "node", "s", "blk", group.alias("g"), pair(F.least).alias("i"), pair(F.greatest).alias("j"))
    checked = units.groupBy("g", "i", "j").applyInArrow(_verify(threshold), "node long, links long, root long")
    checked = materialize(few(checked, n_docs, TEXTS_A_TASK), "checked", TEXTS_A_BATCH)

    found = checked.groupBy("node").agg(F.sum("links").alias("links"))
    real = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), n_docs)
    named = sets.select("node", "rep", "copies").join(real.withColumnRenamed("id", "node"), "node", "left").join(found, "node", "left")
    named = materialize(few(named.withColumn("label", F.coalesce("label", "node")), n_docs), "named")
    classes = materialize(few(named.groupBy("label").agg(F.min("rep").alias("class_id")), n_docs), "classes")
    about = named.join(classes, "label").select("node", "label", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    out = signed.join(materialize(few(about, n_docs), "about").alias("about"), (signed.c1 == F.col("about.node")) & (signed.n > 0), "left")
    some = F.col("n") > 0
    return out.select(
        F.col("d").alias("doc_id"),
        F.when(some, F.col("class_id")).otherwise(F.col("d")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(some, F.col("c1")).alias("set_id"),
        F.when(some, F.col("label")).alias("class_set"),
        F.col("h").alias("text_hash"),
    )


def op2_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents")).drop("set_id", "class_set", "text_hash")


#: Every pair of shingle sets, by shared shingles.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS s FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, s, md5(array_to_string(s, '|')) AS c FROM g),
r AS (SELECT c, min(doc_id) AS rep, count(*) AS copies, any_value(s) AS s FROM k GROUP BY c),
x AS (SELECT c, len(s) AS n, unnest(s) AS t FROM r),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
o(c, root) AS (SELECT c, c FROM r UNION SELECT o.c, e.b FROM o JOIN e ON o.root = e.a),
m AS (SELECT o.c, min(r.rep) AS class_id FROM o JOIN r ON o.root = r.c GROUP BY o.c),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT w.doc_id, coalesce(m.class_id, w.doc_id) AS class_id, coalesce(l.n, 0) AS n_links, coalesce(r.copies, 1) AS n_copies
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN r ON k.c = r.c LEFT JOIN m ON k.c = m.c LEFT JOIN l ON k.c = l.a
"""
