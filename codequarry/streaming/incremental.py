"""Incremental scans (an extension): new files and log rows as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructType

from codequarry.functions import text as T
from codequarry.operators.findings import fingerprint_of, identity_key
from codequarry.registry import EngineConfig

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Occurrences(StatefulProcessor):
    """Numbers the rows of a key in order, on from the number that earlier batches have reached."""

    def __init__(self, order: tuple):
        self.order = order

    def init(self, handle):
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.seen.get()[0] if self.seen.exists() else 0
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            yield Row(**row.asDict(), occurrence=n)
            n += 1
        self.seen.update((n,))

    def close(self):
        pass


def fingerprints(findings: DataFrame, scan: tuple = (), order: tuple = ("ordinal",), key=None, prefix: str = EngineConfig.fingerprint_prefix) -> DataFrame:
    """A stream of findings with the occurrence and fingerprint that operators.findings.fingerprint gives the whole report.

    Batches come in report order; inside one rows may come in any. The state is a
    number for each scan and key, kept in the checkpoint, so a query that is
    started again goes on from there. The rows of one key in one batch are held
    to be sorted, so what a trigger reads bounds them. Null keys are one key, as
    nulls of order go first. The session needs the state store of
    state_store().
    """
    keyed = findings.withColumn("_key", identity_key() if key is None else key)
    schema = StructType([*keyed.schema.fields]).add("occurrence", LongType())
    counted = keyed.groupBy(*scan, "_key").transformWithState(Occurrences(tuple(order)), schema, "Append", "None")
    return counted.withColumn("fingerprint", fingerprint_of(F.col("_key"), F.col("occurrence"), prefix)).drop("_key")


def state_store(spark: SparkSession) -> None:
    """Chooses the state store that keyed state needs, on disk with snapshots in the checkpoint."""
    spark.conf.set(STATE_STORE, ROCKS)


def new_findings(findings: DataFrame, time: str = "found_at", late: str = "1 day") -> DataFrame:
    """Findings whose fingerprint was not seen within the watermark."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])


def usage_windows(log: DataFrame, time: str = "at", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Usage by window and provider, with rows late by no more than late."""
    sums = [F.count("*").alias("scans"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")]
    return log.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "provider").agg(*sums).select("w.start", "w.end", "provider", "scans", "prompt_tokens", "completion_tokens")


def severity_windows(findings: DataFrame, time: str = "found_at", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Penalty by window and scan."""
    weight = F.when(F.col("class") == "vulnerability", T.weight_of(F.col("severity"))).otherwise(0)
    return findings.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "scan_id").agg(F.sum(weight).alias("penalty"), F.count("*").alias("n")).select("w.start", "scan_id", "penalty", "n")


def read_parquet_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def to_parquet(stream: DataFrame, folder: str, checkpoint: str):
    """A query that appends to a folder and ends when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
