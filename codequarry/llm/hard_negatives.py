"""Hard negatives by exact inner products behind a PCA rotation.

An orthogonal rotation does not change inner products, and one whose components
are ordered by the energy they carry gives most of a product in the first few.
A task holds a block of rows and a group of anchors. It adds up the products of
the leading components, and what the rest can still add is at most the product
of the residual norms, plus a slack for rounding; so each row has an upper and a
lower bound of its score. Rows that can't come among the best of any wanted band
of scores are discarded, level by level, and only survivors are multiplied out,
in integers. Bounds decide what is multiplied, never what a score is.

That is done twice: for each anchor's best rows of its own label (the positives),
and then for the best rows of other labels in the band of scores that each
positive allows. Blocks hold rows of one bucket of labels, a label may fill many
blocks, and anchors look for positives in their own bucket's blocks only.

The rotation is fitted for each vector length on about FIT_ROWS rows, chosen by
hash; all rows are indexed, and the fit has no influence on the result. Anchors
are sent to blocks, ANCHORS_A_TASK at most to a task, so a block is read once for
each such group: 2^22 numbers of a block against 2^14 anchors are 7e10
multiplications at most for some 10 MB sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
FIT_ROWS = 20_000
BLOCK_NUMBERS, LEAST_NUMBERS = 1 << 22, 1 << 16  # components of a block: at most, and at least where more blocks would give more tasks work
ANCHORS_A_TASK = 1 << 14
MATRIX = 1 << 21  # first partial products held at a time
ROWS = "row long, id long, label long, n int, x array<long>"
INF = float("inf")


def rotation(x: np.ndarray) -> np.ndarray:
    """Rows are orthonormal directions, those of most energy first."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(initial=0) or 1.0
    _, vectors = np.linalg.eigh((x / scale).T @ (x / scale))
    return np.ascontiguousarray(vectors[:, ::-1].T)


def useful(lower: np.ndarray, upper: np.ndarray, bands, k: int) -> np.ndarray:
    """Which rows may be among the k best of a band (lowest score, highest score), ties included."""
    keep = np.zeros(len(lower), bool)
    for least, most in bands:
        inside = (upper >= least) & (lower <= most)
        sure = lower[(lower >= least) & (upper <= most)]
        if len(sure) >= k:
            inside &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
        keep |= inside
    return keep


class RotatedRows:
    """Integer vectors, rotated, with the norms of what is left behind each level of components."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        d = x.shape[1]
        self.x, self.y = x, x.astype(np.float64) @ turn.T
        self.levels = sorted({-(-d // 8), -(-d // 4), -(-d // 2), d})
        squares = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, k]) if k < d else np.zeros(len(x)) for k in self.levels]
        self.norm = np.sqrt(squares[:, :1].sum(axis=1))
        self.reach = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))))
        # |x.y - (Rx).(Ry)| is at most |x||y| times how far R is from orthogonal, and rounding is at most a few d^1.5 units of |x||y|.
        self.slack = float(np.linalg.norm(turn.T @ turn - np.eye(d))) + 16 * d**1.5 * np.finfo(float).eps


def scores_of(rows: RotatedRows, at: np.ndarray, q: np.ndarray):
    """Integer inner products, as Python's integers where 63 bits may not do."""
    if rows.reach * int(np.abs(q.astype(object)).sum()) >> 62:
        return rows.x[at].astype(object) @ q.astype(object)
    return rows.x[at] @ q


def best(scores, ids: np.ndarray, k: int) -> list[int]:
    """Indexes of the k highest scores, ties by smaller id."""
    if scores.dtype == object:
        found = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in found):
            raise OverflowError("a score among the best does not fit 64 bits")
        return found
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]].tolist()


class LabelledBlock:
    """The rows of one block, and which of them have which label."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.ids, self.labels, self.rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "rows"))
        self.turn = np.frombuffer(row["turn"], np.float64).reshape(self.n, self.n)
        self.index = RotatedRows(np.frombuffer(row["x"], row["kind"]).reshape(len(self.ids), self.n).astype(np.int64), self.turn)
        self.by_label: dict = {}

    def of_label(self, label: int, same: bool) -> np.ndarray:
        if (label, same) not in self.by_label:
            self.by_label[label, same] = np.flatnonzero((self.labels == label) == same)
        return self.by_label[label, same]

    def search(self, anchors: RotatedRows, own: np.ndarray, labels: np.ndarray, bands, k: int, same: bool):
        """For each anchor, in turn, for each of its bands: (rows' indexes, scores) of the k best but the anchor's own row."""
        held, first = self.index, self.index.levels[0]
        step = max(1, MATRIX // max(1, len(self.ids)))
        for at in range(0, len(own), step):
            products = held.y[:, :first] @ anchors.y[at : at + step, :first].T
            for c in range(products.shape[1]):
                yield self._search(anchors, at + c, products[:, c], own[at + c], labels[at + c], bands[at + c], k, same)

    def _search(self, anchors, a: int, products: np.ndarray, own: int, label: int, bands, k: int, same: bool):
        held, wanted = self.index, [b for b in bands if b[0] <= b[1]]
        alive = self.of_label(label, same) if wanted else np.empty(0, np.int64)
        if same:
            alive = alive[self.rows[alive] != own]
        part = products[alive]
        for i, k_now in enumerate(held.levels):
            if i:
                before = held.levels[i - 1]
                part = part + held.y[alive, before:k_now] @ anchors.y[a, before:k_now]
            gap = held.rest[i][alive] * anchors.rest[i][a] + held.slack * held.norm[alive] * anchors.norm[a]
            keep = useful(part - gap, part + gap, [(np.nextafter(float(x), -INF), np.nextafter(float(y), INF)) for x, y in wanted], k)
            alive, part = alive[keep], part[keep]
        scores = scores_of(held, alive, anchors.x[a])
        found = []
        for least, most in bands:
            inside = np.flatnonzero((scores >= least) & (scores <= most)) if len(alive) else np.empty(0, np.int64)
            top = inside[best(scores[inside], self.ids[alive[inside]], k)]
            found.append((alive[top], scores[top]))
        return found


def _numbers(t, name: str = "x"):
    n = t["n"][0].as_py()
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), n).astype(np.int64)


def _fit(key, rows):
    return pa.table({"n": pa.array([key[0].as_py()], pa.int32()), "turn": [rotation(_numbers(rows)).tobytes()]})


def _block(key, rows):
    x = _numbers(rows)
    most = max(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0)))
    kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    numbers = {name: pa.array([k.as_py()], pa.int32()) for name, k in zip(("n", "g", "r"), key)}
    held = {name: [rows[c].to_numpy().astype(np.int64).tobytes()] for name, c in (("ids", "id"), ("labels", "label"), ("rows", "row"))}
    return pa.table(numbers | held | {"kind": [kind], "x": [x.astype(kind).tobytes()]})


def _positives(k: int):
    names = ("row", "id", "score")

    def run(anchors, blocks):
        out = {name: [] for name in names}
        if len(anchors) and len(blocks):
            block = LabelledBlock(blocks.to_pylist()[0])
            own, labels = (anchors[c].to_numpy().astype(np.int64) for c in ("row", "label"))
            asked = RotatedRows(_numbers(anchors), block.turn)
            for row, [(at, scores)] in zip(own.tolist(), block.search(asked, own, labels, [[(-INF, INF)]] * len(own), k, True)):
                out["row"] += [row] * len(at)
                out["id"] += block.ids[at].tolist()
                out["score"] += scores.tolist()
        return pa.table({name: pa.array(out[name], pa.int64()) for name in names})

    return run


def _negatives(k: int, least: int, most: int):
    names = ("row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(anchors, blocks):
        out = {name: [] for name in names}
        if len(anchors) and len(blocks):
            block = LabelledBlock(blocks.to_pylist()[0])
            own, labels = (anchors[c].to_numpy().astype(np.int64) for c in ("row", "label"))
            positives = anchors["positives"].to_pylist()
            scores = [[p["score"] for p in ps] for ps in positives]
            bands = [[(-(-least * s // 100), most * s // 100) for s in sorted(set(ss))] for ss in scores]
            asked = RotatedRows(_numbers(anchors), block.turn)
            search = block.search(asked, own, labels, bands, k, False)
            for row, anchor, ps, ss, found in zip(own.tolist(), anchors["id"].to_pylist(), positives, scores, search):
                by_score = dict(zip(sorted(set(ss)), found))
                for place, p in enumerate(ps):
                    at, got = by_score[p["score"]]
                    for values in zip(block.ids[at].tolist(), got.tolist()):
                        for name, value in zip(names, (row, anchor, place, p["id"], p["score"], *values)):
                            out[name].append(value)
        return pa.table({name: pa.array(out[name], pa.int64()) for name in names})

    return run


def mine_hard_negatives(
    vectors: DataFrame, anchors, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT,
    block_numbers: int = BLOCK_NUMBERS, anchors_a_task: int = ANCHORS_A_TASK, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """For each anchor's best positives, the best rows of other labels that score a given share of the positive's score.

    anchors is a condition on the rows of vectors. Components become
    floor(scale * x); scores are integer inner products with the anchor, higher
    first, ties by smaller id. An anchor's positives are its first rows of the
    same label but itself; a positive's negatives are the first rows of other
    labels with least_percent * positive_score <= 100 * negative_score <=
    most_percent * positive_score (none, if the positive's score is negative).
    Fewer than asked for are returned where there are fewer. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id or label, a null vector, or one with a null or non-finite
    component take no part, and vectors of each length are searched among
    themselves, empty ones too (all their scores are 0). Rows count, not ids:
    rows that repeat an id, a vector or both are anchors, positives and negatives
    of their own, and an anchor leaves out its own row only. Ids and labels are
    cast to long (what is no integer fails). A scaled component beyond 62 bits,
    and a score beyond 64 among a block's best, raise an error. Other columns are
    ignored, whatever their names. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    ok = ok & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF))
    too_wide = F.raise_error(F.lit("a scaled component does not fit 62 bits")).cast("long")
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(1 << 62), F.floor(x * scale).cast("long")).otherwise(too_wide))
    asks = F.expr(anchors) if isinstance(anchors, str) else anchors
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"),
    ).where(ok)
    rows = materialize(rows.select("row", "id", "label", F.size("v").alias("n"), whole.alias("x"), "asks"), "vectors")

    # How rows are dealt: buckets of labels for each length, and blocks for each bucket.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    numbers = F.col("rows") * F.greatest("n", F.lit(1))
    n_blocks = F.greatest(F.ceil(numbers / block_numbers), F.least(F.lit(parts), F.floor(numbers / LEAST_NUMBERS)), F.lit(1))
    sizes = rows.groupBy("n").agg(F.count("*").alias("rows"), F.count_if("asks").alias("asked"))
    sizes = materialize(sizes.select("n", "rows", "asked", n_blocks.cast("int").alias("n_buckets")), "lengths")
    bucket = F.pmod(F.xxhash64("label"), F.col("n_buckets")).cast("int").alias("g")
    dealt = rows.join(sizes.select("n", "n_buckets", F.ceil(F.col("rows") / F.col("n_buckets")).alias("a_block")), "n").select("row", "id", "label", "n", "x", "asks", bucket, "a_block")
    buckets = dealt.groupBy("n", "g").agg(F.ceil(F.count("*") / F.min("a_block")).cast("int").alias("n_rows"), F.count_if("asks").alias("asked"))
    buckets = materialize(buckets, "buckets")
    dealt = dealt.join(buckets.select("n", "g", "n_rows"), ["n", "g"]).withColumn("r", F.pmod(F.xxhash64("row"), F.col("n_rows")).cast("int"))

    chosen = F.pmod(F.xxhash64("row", F.lit(2)), F.col("rows")) < fit_rows
    turns = rows.join(sizes.select("n", "rows"), "n").where(chosen).select("n", "x").groupBy("n").applyInArrow(_fit, "n int, turn binary")
    blocks = dealt.select("row", "id", "label", "n", "x", "g", "r").groupBy("n", "g", "r").applyInArrow(_block, "n int, g int, r int, ids binary, labels binary, rows binary, kind string, x binary")
    blocks = materialize(blocks.join(turns, "n", "left"), "blocks")
    asked = dealt.where("asks")

    def meet(sent: DataFrame, dealing: DataFrame, by: list[str], search, out: str) -> DataFrame:
        """Sends anchors to all blocks of their key, in groups, enough of them that all tasks have work where there are few blocks."""
        groups = F.greatest(F.ceil(F.col("asked") / anchors_a_task), F.least("asked", F.ceil(F.lit(2 * parts) / F.col("blocks")))).cast("int").alias("n_groups")
        groups = dealing.where("asked > 0").select(*by, groups)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        places = groups.join(buckets.select("n", "g", "n_rows"), by).withColumn("r", every("n_rows"))
        sent = sent.join(places.select("n_groups", *by, *[F.col(c).alias(f"to_{c}") for c in ("g", "r")]), by)
        sent = sent.withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.col("n_groups")).cast("int")).drop("n_groups")
        held = blocks.join(groups, by).withColumn("group", every("n_groups")).drop("n_groups")
        return sent.groupBy("n", "to_g", "to_r", "group").cogroup(held.groupBy("n", "g", "r", "group")).applyInArrow(search, out)

    near = meet(asked.drop("r", "n_rows", "a_block"), buckets.withColumn("blocks", F.col("n_rows")), ["n", "g"], _positives(positives), "row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= positives)
    near = materialize(near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")

    anchored = asked.select("row", "id", "label", "n", "x").join(near, "row")
    all_blocks = sizes.select("n", "asked").join(buckets.groupBy("n").agg(F.sum("n_rows").alias("blocks")), "n")
    out = "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = meet(anchored, all_blocks, ["n"], _negatives(negatives, least_percent, most_percent), out)
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), "vec_id % 50 = 0")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.x) = len(c.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
m AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM m WHERE n <= 3
"""
