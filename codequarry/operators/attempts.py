"""Requests out of a log of attempts: which are retries of one request, and when the next was due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.folds import checkpointed, running

TRIES = 5
LONGEST_WAIT = 120
RATE_LIMIT = "rate limit|rate_limit|too many requests|429"


def retryable(status, error):
    """Whether another try may help: no status (a timeout, a lost connection), 408, 409, 429 and 500 on; never without credits."""
    return ~F.coalesce(F.lower(error).contains("insufficient credits"), F.lit(False)) & F.coalesce(status.isin(408, 409, 429) | (status >= 500), F.lit(True))


def back_off(attempt, status, error):
    """Seconds to wait after a failed attempt (from 1): 2, 4, 8, 16; under a rate limit 15, 30, 60, 120."""
    limited = F.coalesce(status == 429, F.lit(False)) | F.coalesce(F.lower(error).rlike(RATE_LIMIT), F.lit(False))
    return F.when(limited, F.least(F.lit(LONGEST_WAIT), 15 * F.pow(2, attempt - 1))).otherwise(F.pow(2, attempt)).cast("int")


def requests(log: DataFrame, by: tuple, order: tuple) -> DataFrame:
    """Each attempt with its request: first (its place along the key, from 1, of the request's first attempt), attempt (from 1), state, wait.

    log: (by..., order..., ok, status, error). A request ends with an attempt that
    is ok or not worth another, or with its last try; so between two such ends a
    run of failures is cut into requests of TRIES. state: ok, refused, gave_up
    (last try), or retried. wait: seconds until the next try, null where there is
    none. A key of any length is dealt over ranges.
    """
    ends = F.coalesce("ok", F.lit(False)) | ~retryable(F.col("status"), F.col("error"))
    placed = checkpointed(running(log, by, order, {"_before": (F.sum, F.lit(1))}).withColumns({"_at": F.col("_before") + 1, "_ends": ends}))
    since = running(placed, by, order, {"_last": (F.max, F.when(F.col("_ends"), F.col("_at")))})
    attempt = ((F.col("_at") - F.coalesce("_last", F.lit(0)) - 1) % TRIES + 1).cast("int")
    out = since.withColumn("attempt", attempt).withColumn("first", F.col("_at") - F.col("attempt") + 1)
    state = F.when(F.coalesce("ok", F.lit(False)), "ok").when(F.col("_ends"), "refused").when(F.col("attempt") == TRIES, "gave_up").otherwise("retried")
    wait = F.when(F.col("state") == "retried", back_off(F.col("attempt"), F.col("status"), F.col("error")))
    return out.withColumn("state", state).withColumn("wait", wait).select(*log.columns, "first", "attempt", "state", "wait")
