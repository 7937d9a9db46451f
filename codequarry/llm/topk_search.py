"""Exact top-k search by inner product over a bit-sliced index.

Rows are dealt into blocks, and each block is indexed once and written. In a
block every component is an attribute kept in bit slices: one bitmap over the
block's rows for each bit of the component, less its DROPPED lowest bits
(quantised, shifted to be non-negative). A query adds the slices weighted by its
components: slice i of a component times digit j of the query's goes to weight
i + j, complemented where the digit is negative, and carry-save adders reduce
the bitmaps of a weight to one. From the sums' most significant slice downward
the usual walk finds the k-th largest quantised score; every row within twice
the quantisation's error of it is a boundary row, and these are resolved with
exact integer products. So a block's k best are exact, ties by smaller id, and
the k best of all blocks are too.

Queries are sent to the written blocks, QUERIES_A_TASK at most to a task; a
block is read once for each such group of queries. Tasks give k rows a query,
and a window takes the k best of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

K, SCALE = 10, 1024
BLOCK_NUMBERS, QUERIES_A_TASK = 1 << 22, 1 << 14  # components of a row block; queries that one task asks it
DROPPED = 4
U8 = np.uint64


def digits(value: int) -> list[tuple[int, bool]]:
    """Non-adjacent form of a non-negative integer: (position, negative)."""
    out, at = [], 0
    while value:
        if value & 1:
            d = 2 - (value & 3)
            out.append((at, d < 0))
            value -= d
        value >>= 1
        at += 1
    return out


def add_up(columns: dict) -> list:
    """Bitmaps by weight -> one bitmap a weight, by carry-save adders."""
    total, w = [], 0
    while w <= max(columns, default=-1):
        maps = columns.get(w, [])
        while len(maps) > 1:
            carry = columns.setdefault(w + 1, [])
            if len(maps) > 2:
                a, b, c = maps.pop(), maps.pop(), maps.pop()
                x = a ^ b
                carry.append((a & b) | (x & c))
                maps.insert(0, x ^ c)
            else:
                a, b = maps.pop(), maps.pop()
                carry.append(a & b)
                maps.append(a ^ b)
        total.append(maps[0] if maps else None)
        w += 1
    return total


def kth_largest(slices: list, valid: np.ndarray, k: int) -> int:
    """The k-th largest value of the valid rows (their smallest if there are fewer)."""
    open_, above, value = valid, 0, 0
    for w in range(len(slices) - 1, -1, -1):
        s = slices[w]
        ones = open_ & s if s is not None else np.zeros_like(open_)
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            open_, value = ones, value | 1 << w
        else:
            above += n
            open_ = open_ & ~s if s is not None else open_
            if not open_.any() and not n:
                return 0
    return value


def at_least(slices: list, valid: np.ndarray, bound: int) -> np.ndarray:
    """Valid rows whose value is bound or more."""
    if bound <= 0:
        return valid
    if bound >> len(slices):
        return np.zeros_like(valid)
    more, same = np.zeros_like(valid), valid
    for w in range(len(slices) - 1, -1, -1):
        s = slices[w] if slices[w] is not None else np.zeros_like(valid)
        if bound >> w & 1:
            same = same & s
        else:
            more = more | (same & s)
            same = same & ~s
    return more | same


class SlicedBlock:
    """The index of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dropped: int = DROPPED, keys: np.ndarray | None = None):
        self.ids, self.x, self.dropped = ids, x, dropped
        self.keys = ids if keys is None else keys  # by which a query leaves out its own
        n = len(ids)
        self.words = -(-n // 64)
        high = x >> dropped
        moved = high - high.min(0)
        width = [int(m).bit_length() for m in moved.max(0)]
        self.slices = [self._pack(((moved[:, d][None, :] >> np.arange(b)[:, None]) & 1).astype(np.uint8)) for d, b in enumerate(width)]
        self._rest()

    def _rest(self):
        self.valid = self._pack(np.ones((1, len(self.ids)), np.uint8))[0]
        self.reach = [max(abs(int(a)), abs(int(b))) for a, b in zip(self.x.min(0), self.x.max(0))]

    def row(self) -> dict:
        """What is written: ids, components in as few bytes as they need, and slices."""
        most = max(self.reach, default=0)
        kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
        return {"ids": self.ids.tobytes(), "keys": self.keys.tobytes(), "kind": kind, "x": self.x.astype(kind).tobytes(), "width": [len(s) for s in self.slices], "slices": b"".join(s.tobytes() for s in self.slices)}

    @classmethod
    def read(cls, row: dict, dropped: int):
        self = cls.__new__(cls)
        self.ids, self.keys, self.dropped = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64), dropped
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(len(self.ids), -1 if row["x"] else 0).astype(np.int64)
        self.words = -(-len(self.ids) // 64)
        every = np.frombuffer(row["slices"], U8).reshape(-1, self.words)
        self.slices = np.split(every, np.cumsum(row["width"])[:-1]) if row["width"] else []
        self._rest()
        return self

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 64), np.uint8)
        out[:, : bits.shape[1]] = bits
        return np.packbits(out, axis=1, bitorder="little").view(U8)

    def search(self, q: np.ndarray, k: int, own: int | None = None):
        """(ids, scores) of the k best but those of key own."""
        if own is not None:
            k += int((self.keys == own).sum())
        columns: dict = {}
        for d, weight in enumerate(q.tolist()):
            for at, negative in digits(abs(weight)):
                minus = negative != (weight < 0)
                for i, bitmap in enumerate(self.slices[d]):
                    columns.setdefault(i + at, []).append(~bitmap & self.valid if minus else bitmap)
        sums = add_up(columns)
        best = kth_largest(sums, self.valid, k)
        # A dropped part of 0 to 2**dropped - 1 times each weight moves a score by less than this.
        error = ((1 << self.dropped) - 1) * sum(map(abs, q.tolist()))
        bound = best - -(-error >> self.dropped) - 1
        rows = np.flatnonzero(np.unpackbits(at_least(sums, self.valid, bound).view(np.uint8), bitorder="little")[: len(self.ids)])
        if own is not None:
            rows = rows[self.keys[rows] != own]
            k -= int((self.keys == own).sum())
        # By Python's integers where a sum, or a part of one, could leave 63 bits.
        wide = sum(r * abs(int(w)) for r, w in zip(self.reach, q)) >> 63
        scores = self.x[rows].astype(object) @ q.astype(object) if wide else self.x[rows] @ q
        if len(rows) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        order = np.lexsort((self.ids[rows], -scores))[:k] if not wide else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k], int)
        if wide and any(not -(1 << 63) <= s < 1 << 63 for s in scores[order]):
            raise OverflowError("a score among the best does not fit 64 bits")
        return self.ids[rows[order]], scores[order].astype(np.int64)


def _vectors(t, n: int):
    return t["id"].to_numpy(), t["key"].to_numpy(), t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), n).astype(np.int64)


INDEX = pa.schema([("n", pa.int32()), ("r", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("kind", pa.string()), ("x", pa.binary()), ("width", pa.list_(pa.int32())), ("slices", pa.binary())])


def _build(dropped: int):
    def run(key, rows):
        n, r = (k.as_py() for k in key)
        ids, keys, x = _vectors(rows, n)
        return pa.Table.from_pylist([{"n": n, "r": r} | SlicedBlock(ids, x, dropped, keys).row()], INDEX)

    return run


def _search(k: int, dropped: int):
    out = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, queries, index):
        got = ([], [], [], [])
        if len(queries) and len(index):
            block = SlicedBlock.read(index.to_pylist()[0], dropped)
            for id_, own, q in zip(*_vectors(queries, key[0].as_py())):
                found, scores = block.search(q, k, int(own))
                for column, values in zip(got, (np.full(len(found), own), np.full(len(found), id_), found, scores)):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in got], schema=out)

    return run


def topk_search(
    vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE,
    block_numbers: int = BLOCK_NUMBERS, queries_a_task: int = QUERIES_A_TASK, dropped: int = DROPPED,
) -> DataFrame:
    """The k rows of vectors with the largest integer inner product, for each query.

    queries is a condition on vectors, as SQL, or rows of their own. Components
    become floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller vec_id; fewer than k rows where there are fewer. With a
    condition every row that it holds for is asked and leaves out itself only, so
    rows that repeat an id ask and find one another. With rows of their own,
    queries never find rows of their id, and of queries that repeat an id the
    smallest vector is asked. Vectors of each length are
    searched among themselves, empty ones too (all their scores are 0). Rows
    with a null id, a null vector, or one with a null or non-finite component
    take no part. Ids are cast to long (an id that is no integer fails). Rows
    that repeat an id are candidates of their own, however many. A scaled component beyond 62 bits, and
    a score beyond 64 among a block's best, raise an error. Other columns are
    ignored, whatever their names. Empty tables give an empty result. Rows are
    dealt by their order in vectors, which should be read from files; the result
    does not depend on how they are dealt.
    """
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: F.when(F.abs(x * scale) < float(1 << 62), F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a scaled component does not fit 62 bits")).cast("long"))

    def whole(df, key, asks):
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), key.alias("key"), asks.alias("asks")).where(ok)
        return df.select("id", "key", F.size("v").alias("n"), F.transform("v", fits).alias("x"), "asks")

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if isinstance(queries, str):
        rows = materialize(whole(vectors, F.monotonically_increasing_id(), F.coalesce(F.expr(queries), F.lit(False))), "vectors")
        asked = rows.where("asks").select("id", "key", "n", "x")
    else:
        own = F.col(id_col).cast("long")
        rows = whole(vectors, own, F.lit(False))
        asked = whole(queries, own, F.lit(True)).groupBy("id").agg(F.min(F.struct("x", "n")).alias("q")).select("id", F.col("id").alias("key"), "q.n", "q.x")
    rows = rows.drop("asks")
    blocks = rows.groupBy("n").agg(F.ceil(F.count("*") * F.greatest("n", F.lit(1)) / block_numbers).cast("int").alias("n_rows"))
    many = asked.groupBy("n").agg(F.count("*").alias("asked"))
    # Enough groups of queries that all tasks have work where there are few blocks, and no more than queries.
    groups = F.greatest(F.ceil(F.col("asked") / queries_a_task), F.least("asked", F.ceil(F.lit(2 * parts) / F.col("n_rows"))))
    dealing = materialize(blocks.join(many, "n").select("n", "n_rows", groups.cast("int").alias("n_asked")), "dealing")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.withColumn("o", F.monotonically_increasing_id()).join(dealing, "n").select("n", F.pmod("o", "n_rows").cast("int").alias("r"), "id", "key", "x")
    index = dealt.groupBy("n", "r").applyInArrow(_build(dropped), "n int, r int, ids binary, keys binary, kind string, x binary, width array<int>, slices binary")
    index = materialize(index, "index")
    held = index.join(dealing, "n").select(*index.columns, every("n_asked").alias("a"))
    sent = asked.join(dealing, "n").select("n", "id", "key", "x", F.pmod(F.xxhash64("key", F.lit(1)), F.col("n_asked")).cast("int").alias("a"), every("n_rows").alias("r"))
    near = sent.groupBy("n", "a", "r").cogroup(held.groupBy("n", "a", "r")).applyInArrow(_search(k, dropped), "key long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark, sf_dir):
    return topk_search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10
"""
