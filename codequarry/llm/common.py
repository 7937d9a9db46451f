"""Shared pieces: shared-folder tables, buckets, rolling hashes, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a temporary folder serves a local session, whose
    executors live in the driver; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codequarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_WRITTEN: list[str] = []


def drop_tables(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Delete what materialize() has written in this process, from the since-th table on; call it when results have been stored."""
    going = _WRITTEN[since : -1 if keep_last else None]
    jvm = spark.sparkContext._jvm
    for found in going:
        path = jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(found)
    return len(going)


def stored(make, name: str) -> DataFrame:
    """What make() returns, written and read back; the tables that were written on the way there are deleted."""
    since = len(_WRITTEN)
    out = materialize(make(), name)
    drop_tables(out.sparkSession, since, keep_last=True)
    return out


TEXTS_A_BATCH = 1_000  # rows of texts that a Python worker holds at once: an executor holds them as often as it has cores, in the JVM and in Python
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts lineage, and the plan above it starts from a plain scan, so both
    sides of a join get an exchange that AQE can split when it is skewed. With
    batch, Python workers on the way are sent at most so many rows at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, batch)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


DOCS_A_TASK, TEXTS_A_TASK = 10_000, 2_000  # for tables of numbers, and for texts or much work a document


def few(df: DataFrame, documents: int, each: int = DOCS_A_TASK) -> DataFrame:
    """df in few partitions where it comes of few documents: one for each so many of them, and for each core; never in more than it has.

    Every file that is written costs a file's overhead, and on a local disk two
    short processes of the executor, however few rows it holds.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-documents // each)))


def kept(docs: DataFrame, keep):
    """The columns of keep as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")


def kept_type(docs: DataFrame, keep) -> str:
    return docs.select(kept(docs, keep).alias("k")).schema["k"].dataType.simpleString()


def bucket_count(docs: DataFrame, text_col: str, target_bytes: int) -> int:
    """Buckets of about target_bytes of text each, and a few for every shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(3 * parts, -(-total // target_bytes))


# Words are runs of ASCII letters and digits and of all bytes beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | str | None) -> list:
    """The words of a text; bytes need not be valid UTF-8."""
    if isinstance(text, str):
        text = text.encode()
    return text.translate(_FOLD).split() if text else []


# --- hashes of words and of runs of words, in numpy -------------------------

_B1, _B2 = 0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F  # both 3 mod 4
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered; emptied when it grows large."""

    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        got = _POWERS[base] = tuple(both)
    return got[0][:n], got[1][:n]


def rolling(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of each run of k values of h; len(h) - k + 1 of them."""
    n = len(h)
    if n < k:
        return np.empty(0, U)
    up, down = _powers(_B2 if second else _B1, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(h * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost smallest of each w neighbours of g."""
    v, at, size = g, np.arange(len(g)), 1
    while size < w:
        off = min(size, w - size)
        take = v[off:] < v[:-off]
        v = np.where(take, v[off:], v[:-off])
        at = np.where(take, at[off:], at[:-off])
        size += off
    return at


def isin_sorted(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are in the sorted array, and where."""
    if not len(ordered):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x, at


# --- connected components ----------------------------------------------------


EDGES_A_TASK = 500_000


def components(edges: DataFrame, documents: int | None = None) -> DataFrame:
    """(id, label): label is the smallest id of id's component; edges: (a, b), longs, of so many documents if that is known.

    Randomised contraction: each round every node that has edges goes to the
    smallest of its neighbours and itself by a hash that is new each round, and
    edges are drawn between what the nodes went to, until none is left. At most
    three quarters of the nodes are expected to stay each round on any graph, so
    rounds grow with the logarithm of the nodes, whatever the diameter; as a
    node of the largest hash never stays, they always end. Then the rounds are
    read backwards. Edges and steps are written to the shared folder. Nodes of
    any degree are reduced by partial aggregation, and joins start from plain
    scans.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both if documents is None else few(both, documents), "edges")
    steps = []
    while n := both.count():
        tasks = max(1, -(-n // EDGES_A_TASK))  # rounds shrink: small ones are written by few tasks
        drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        step = both.groupBy(F.col("a").alias("id")).agg(F.min(drawn("b")).alias("near")).select("id", F.least("near", drawn("id")).getField("to").alias("to"))
        step = materialize(step.coalesce(tasks), "step")
        steps.append(step)
        moved = both.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        both = materialize(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(tasks), "edges")
    if not steps:
        return both.select(F.col("a").alias("id"), F.col("b").alias("label"))
    tasks = max(1, -(-steps[0].count() // EDGES_A_TASK))
    roots = steps.pop()
    while steps:
        higher = roots.select(F.col("id").alias("to"), F.col("to").alias("root"))
        roots = materialize(steps.pop().join(higher, "to", "left").select("id", F.coalesce("root", "to").alias("to")), "roots")
    least = materialize(roots.groupBy("to").agg(F.min("id").alias("label")).coalesce(tasks), "least")
    return materialize(roots.join(least, "to").select("id", "label"), "labels")


# --- a filter of bounded size ------------------------------------------------


FLAGS_A_HASH = 128


def low_bits(df: DataFrame, column: str, total: int, most_bits: int) -> np.ndarray:
    """A bitmap of the low parts of the hashes in column: FLAGS_A_HASH flags a hash, but at most most_bits.

    It goes to the executors as a constant; what it lets pass is then joined. A
    table too large for most_bits only makes it let more pass.
    """
    bits = 1 << 16
    while bits < min(FLAGS_A_HASH * total, most_bits):
        bits *= 2
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(31)).cast("int"))
    out = np.zeros(bits // 32, np.uint32)
    for r in df.groupBy(F.shiftright(low, 5).alias("at")).agg(F.bit_or(one).alias("set")).toLocalIterator():
        out[r["at"]] = r["set"]
    return out.view(np.uint8)


def flags(bitmap: np.ndarray) -> np.ndarray:
    """The flags of a bitmap of low_bits, one byte each."""
    return np.unpackbits(bitmap, bitorder="little").view(bool)
