"""The engine: scan, compare, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.detect.access import analyse
from codequarry.operators import findings as O
from codequarry.operators import scans
from codequarry.php.facts import Facts
from codequarry.registry import EngineConfig
from codequarry.sinks import reports
from codequarry.sources import files as sources


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()):
        self.spark, self.config = spark, config

    def analyse(self, files: DataFrame, routes: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
        """Fingerprinted findings of source files, less a baseline's."""
        found = analyse(Facts(files), routes)
        content = files.select(F.col("path").alias("location"), "content")
        known = found.join(content, "location", "left")
        coded = O.fingerprint(known, (), ("detector", "location", "line", "description"), O.identity_key(content=F.coalesce("content", F.lit(""))), self.config.fingerprint_prefix).drop("content")
        return O.without_baseline(coded, baseline) if baseline is not None else coded

    def scan(self, root: str, **how) -> DataFrame:
        return self.analyse(sources.scan(self.spark, root, self.config), **how)

    def scan_path(self, root: str, target: str, **how) -> DataFrame:
        path = sources.checked_target(root, target, self.config)
        return self.analyse(sources.scan(self.spark, root, self.config, [path]), **how)

    def scan_diff(self, root: str, base: str | None = None, **how) -> DataFrame:
        return self.analyse(sources.scan_diff(self.spark, root, base, self.config), **how)

    def scan_code(self, code: str, **how) -> DataFrame:
        return self.analyse(sources.inline(self.spark, code), **how)

    def coverage(self, files: DataFrame) -> dict:
        """How much of the files could be read."""
        bad = Facts(files).errors.select("path", F.lit("unreadable").alias("reason"))
        row = scans.coverage(files.select("path").join(bad, "path", "left")).first()
        return {"files_discovered": row.discovered, "files_analyzed": row.analyzed, "files_skipped": row.skipped, "percent_analyzed": row.percent_analyzed, "complete": row.complete}

    def report(self, findings: DataFrame, coverage: dict | None = None) -> dict:
        """Counts and score of findings; reports.lines() makes a document of it and them."""
        return reports.summary(findings, coverage)
