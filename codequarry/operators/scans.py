"""Scans: coverage, usage, cost, history, chunks and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators.folds import admit, fold_chunks  # noqa: F401  (part of this module's interface)
from codequarry.registry import SKIP_REASONS


def percent(part, whole):
    return F.when(whole > 0, F.round(F.least(F.lit(100.0), part / whole * 100), 1)).otherwise(0.0)


def coverage(files: DataFrame, by=()) -> DataFrame:
    """files: (..., reason), reason null where the file was analysed."""
    found = files.groupBy(*by).agg(F.count("*").alias("discovered"), F.count_if(F.col("reason").isNull()).alias("analyzed"), F.count("reason").alias("skipped"))
    return found.withColumn("percent_analyzed", percent(F.col("analyzed"), F.col("discovered"))).withColumn("complete", (F.col("skipped") == 0) & (F.col("discovered") > 0))


def skips(files: DataFrame, by=()) -> DataFrame:
    """Skipped files by reason, with its wording; paths sorted. A reason of one scan is one row."""
    label = F.coalesce(*[F.when(F.col("reason") == r, text) for r, text in SKIP_REASONS.items()], F.col("reason"))
    return files.where("reason is not null").groupBy(*by, "reason").agg(F.array_sort(F.collect_list("path")).alias("paths")).withColumn("reason_label", label)


def suppressed_score(scans: DataFrame) -> DataFrame:
    """Score withheld with a reason when the target failed or coverage is empty or incomplete."""
    reason = F.when(F.col("target_error").isNotNull(), F.col("target_error")).when(F.col("discovered") == 0, "no files were analysed").when(F.col("analyzed") < F.col("discovered"), "coverage is incomplete")
    return scans.withColumn("suppression_reason", reason).withColumn("score", F.when(reason.isNull(), F.col("score")))


def chunk_coverage(chunk_files: DataFrame, responses: DataFrame) -> DataFrame:
    """Files of chunks whose response was truncated count only when the response mentions them.

    chunk_files: (chunk, path); responses: (chunk, state ok|truncated|failed, locations array).
    """
    r = responses.select("chunk", "state", "locations")
    reason = F.when(F.coalesce("state", F.lit("failed")) == "failed", "ai_failure").when((F.col("state") == "truncated") & ~F.coalesce(F.array_contains("locations", F.col("path")), F.lit(False)), "ai_failure")
    return chunk_files.join(r, "chunk", "left").select("chunk", "path", reason.alias("reason"))


def usage_summary(log: DataFrame, by=()) -> DataFrame:
    return log.groupBy(*by).agg(
        F.count("*").alias("scans"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"), F.sum("requests").alias("requests"),
    )


def usage_since(log: DataFrame, since) -> DataFrame:
    """Rows from a moment on, compared as time, whatever the offset they were written with."""
    return log.where(F.col("timestamp") >= since)


def cost(tokens_in, tokens_out, rate_in, rate_out):
    """Price of tokens at rates per million, to four places."""
    return F.round(tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out, 4)


def limit_state(used, limit):
    """(remaining, percent used) of a limit; null remaining and 0 percent without one."""
    tenths = F.round(used / limit * 100 * 10)  # a half as the scaled number has it: 1,800 of 400,000 are 0.44999999999999996 %, and 0.5 rounded
    return F.when(limit > 0, F.greatest(F.lit(0), limit - used)).alias("remaining"), F.when(limit > 0, tenths / 10).otherwise(0.0).alias("percent_used")


def beginnings(col):
    """All beginnings of a string, itself included, but for the empty one."""
    return F.transform(F.sequence(F.lit(1), F.length(col)), lambda n: F.substring(col, F.lit(1), n))


def price_lookup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage rows (provider, model) with input and output rates.

    In turn: the model of the provider, one of the provider's that begins the
    name or begins with it, the model anywhere, such a one anywhere. The first
    in the registry's order wins. Distinct models are looked up once, by
    equality with the beginnings of the names, on either side; an empty name is
    no model.
    """
    asked = usage.select("provider", "model").where("model <> ''").distinct()
    known = prices.select(F.lower("provider").alias("p"), F.col("model").alias("m"), "input", "output", F.col("ordinal").alias("o")).where("m <> ''")
    longer = asked.select("provider", "model", F.explode(beginnings(F.col("model"))).alias("m")).join(known, "m")
    shorter = asked.join(known.withColumn("model", F.explode(beginnings(F.col("m")))).where("model <> m"), "model")
    columns = ["provider", "model", "p", "m", "input", "output", "o"]
    own = F.col("p") == F.lower("provider")
    step = F.when(own & (F.col("m") == F.col("model")), 1).when(own, 2).otherwise(3)
    pairs = longer.select(*columns).union(shorter.select(*columns)).withColumn("step", step)
    best = pairs.groupBy("provider", "model").agg(F.min_by(F.struct("input", "output", "m"), F.struct("step", "o")).alias("b"))
    best = best.select("provider", "model", "b.input", "b.output", F.col("b.m").alias("priced_as"))
    return usage.join(best, ["provider", "model"], "left")


def score_delta(history: DataFrame, by=(), order="id") -> DataFrame:
    """Each scan's change against the one before; null when either score is withheld."""
    return history.withColumn("delta", F.col("score") - F.lag("score").over(Window.partitionBy(*by).orderBy(order)))


def recent(history: DataFrame, n: int, order="id") -> DataFrame:
    return history.orderBy(F.desc(order)).limit(n)


def merge_reports(reports: DataFrame, by=("scan_id",)) -> DataFrame:
    """Chunk reports of a scan as one: mean score, summaries in order, the idea of the lowest score."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "summary"))), lambda x: x["summary"])
    return reports.groupBy(*by).agg(F.round(F.avg("score")).cast("int").alias("score"), F.array_join(F.filter(ordered, lambda s: s != ""), "\n\n").alias("summary"), F.min_by("idea", F.struct("score", "chunk")).alias("idea"))


def tokens_by(files: DataFrame, by=(), content="content") -> DataFrame:
    return files.groupBy(*by).agg(F.sum(T.tokens(F.col(content))).alias("tokens"))
