"""Mixing sources to target weights by distributed prefix sums.

Each row gets a hash-random key. The key's first two bytes are two levels of
ranges with bounds known beforehand (uniform keys need no sampling), so a source
is in order of its ranges without being sorted, and prefix sums of words go over
at most 256 ranges of a source, then over at most 256 ranges of the range where
its budget runs out, then over the keys of that range (1/65536 of a source),
which alone are sorted. That gives the key at which the source is cut: rows
before it are taken whole, rows behind it not, rows that have it in part. Whole
epochs come first.

Plan: two scans count words (the first by range, the last for the rows), one
between them reads keys and counts the words of the ranges at the cuts only.
Texts are never shuffled. Rows with one key, which are equal rows, are one row
of the sums, and get equal parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, kept, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(s, source_size, target) from (s, source_size), one row per source.

    Targets are proportional to the weights, which the sources take in turn by
    code point (null last), but stop at most times the source's size; the excess
    goes to the others by weight until none is above: that is one level, found
    from running sums over the sources in order of cap / weight. One task holds
    a row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("s").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0)
    level = caps.withColumn("level", (wanted - before) / after).withColumn("at", F.row_number().over(order))
    free = level.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("at", "level"))).over(everything)["level"])
    return free.select("s", "source_size", F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("w")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def crossing(sums: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows of sums (sum; rest, what of the budget is left) in which rest runs out, going by order within by; rest is then what is left in them."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = sums.withColumn("rest", F.col("rest") - F.coalesce(F.sum("sum").over(before), F.lit(0)))
    return left.where((F.col("rest") >= 0) & (F.col("rest") < F.col("sum")))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: str = SEED, keep: tuple = ()
) -> DataFrame:
    """How many words of each row the mix takes.

    Returns a row per input row: doc_id, size, source, source_size, target,
    taken (whole epochs of the row and what the cut leaves of it), epochs (times
    the row is used, the last perhaps in part). A null text has size 0 and gives
    nothing; null sources are one source, the last. A source's words taken are
    its target, rounded down, but for rows that repeat an id and text where it is
    cut: those get equal parts, in whole words. Reruns agree: keys depend on
    seed, id and text only. Ids of any type come back as they are. Bytes that are
    no valid UTF-8 count as U+FFFD; a text of any length is one row of a scan. An
    empty table gives an empty result. Columns named in keep come back as the
    struct kept; others are ignored, whatever their names. Targets are levelled
    over one row a source, in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    size = lambda t: F.regexp_count(t, F.lit(WORD)).cast("long")
    source = [F.col(source_col).isNull().alias("z"), F.coalesce(F.col(source_col), F.lit("")).alias("k")]
    keyed = docs.select(*source, text.alias("t"), key.alias("key")).withColumn("a", F.substring("key", 1, 2)).withColumn("b", F.substring("key", 3, 2))
    fine = materialize(few(keyed.groupBy("z", "k", "a", "b").agg(F.sum(size(F.col("t"))).alias("sum")), docs.count()), "fine")
    coarse = fine.groupBy("z", "k", "a").agg(F.sum("sum").alias("sum"))
    sizes = fine.groupBy(F.when(~F.col("z"), F.col("k")).alias("s")).agg(F.sum("sum").alias("source_size"))
    goal = targets(sizes, weights, share_percent, most).select(F.col("s").isNull().alias("z"), F.coalesce("s", F.lit("")).alias("k"), "source_size", "target")
    budget = F.floor("target")
    times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    goal = materialize(goal.withColumn("times", times).withColumn("rest", budget - F.col("times") * F.col("source_size")), "goal")
    # Where the rest of the budget runs out: a range, a range of that, a key of that. A source of which nothing is left to cut has none.
    ranges = crossing(coarse.join(goal.select("z", "k", "rest"), ["z", "k"]), ["z", "k"], "a").select("z", "k", "a", "rest")
    ranges = crossing(fine.join(ranges, ["z", "k", "a"]), ["z", "k"], "b").select("z", "k", "a", "b", "rest")
    inside = keyed.join(materialize(ranges, "ranges"), ["z", "k", "a", "b"])
    keys = inside.groupBy("z", "k", "key", "rest").agg(F.sum(size(F.col("t"))).alias("sum"), F.count("*").alias("rows"))
    cuts = crossing(keys, ["z", "k"], "key").select("z", "k", F.col("key").alias("cut"), F.floor(F.col("rest") / F.col("rows")).alias("part"))
    goal = materialize(goal.join(cuts, ["z", "k"], "left"), "cuts").alias("g")
    rows = docs.select(F.col(id_col).alias("doc_id"), size(text).alias("size"), F.col(source_col).alias("source"), *source, key.alias("key"), kept(docs, keep).alias("kept")).alias("r")
    full = rows.join(goal, (F.col("r.z") == F.col("g.z")) & (F.col("r.k") == F.col("g.k")))
    part = F.when(F.col("cut").isNull() | (F.col("key") > F.col("cut")), F.lit(0)).when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.col("part"))
    taken = (F.col("times") * F.col("size") + part).cast("long")
    epochs = F.when(F.col("size") > 0, F.col("times") + (part > 0).cast("long")).otherwise(F.lit(0)).cast("long")
    return full.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), epochs.alias("epochs"), *(["kept"] if keep else []))


def op6_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "epochs")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, (CAST(sum(source_size) OVER () * 150 AS BIGINT) / 100.0::DOUBLE - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
  / CAST(sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS rnk FROM s),
l AS (SELECT arg_min(level, rnk) AS level FROM c WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL OR cap <= l.level * w THEN CAST(cap AS DOUBLE) ELSE l.level * w END AS target FROM c LEFT JOIN l ON true),
q AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS sum, count(*) AS n FROM d GROUP BY source, key),
p AS (SELECT q.source, key, n, sum, source_size, target, CAST(floor(target) AS BIGINT) AS budget, coalesce(CAST(sum(sum) OVER (PARTITION BY q.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(sum, budget - budget // source_size * source_size - start)) // n END AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key
"""
