"""Command line: scan, report, explain."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="codequarry")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("root")
    s.add_argument("--path")
    s.add_argument("--diff", nargs="?", const="")
    s.add_argument("--routes")
    s.add_argument("--baseline")
    s.add_argument("--format", choices=["json", "sarif", "markdown", "html"], default="json")
    s.add_argument("--fail-on", choices=["critical", "high", "medium", "low", "none"], default="high")
    s.add_argument("--minimum", choices=["critical", "high", "medium", "low"], default="low")
    e = sub.add_parser("explain")
    e.add_argument("type")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from codequarry.api import Engine
    from codequarry.detect.access import explain
    from codequarry.registry import WEIGHT
    from codequarry.sinks import reports
    from codequarry.sources import documents
    from codequarry.sources.files import TargetError

    spark = SparkSession.builder.getOrCreate()
    if a.command == "explain":
        row = explain(spark, a.type).first()
        print(json.dumps(row.asDict(True) if row else None, indent=2))
        return 0 if row else 1
    engine = Engine(spark)
    how = {"routes": documents.routes(spark, a.routes) if a.routes else None, "baseline": documents.baseline(spark, a.baseline) if a.baseline else None}
    try:
        found = engine.scan_diff(a.root, a.diff or None, **how) if a.diff is not None else engine.scan_path(a.root, a.path, **how) if a.path else engine.scan(a.root, **how)
        least = [k for k, w in WEIGHT.items() if w >= WEIGHT[a.minimum]]
        found = found.where(F.col("severity").isin(least)).persist()
    except TargetError as x:
        print(x, file=sys.stderr)
        return 2
    report = reports.summary(found)
    for line in reports.text(reports.lines(found, a.format, report)):
        print(line)
    least = WEIGHT.get(a.fail_on)
    found.unpersist()
    return int(least is not None and any(report["counts"][k] for k, w in WEIGHT.items() if w >= least))


if __name__ == "__main__":
    sys.exit(main())
