"""Accuracy against ground truth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.findings import line_clusters


def ratio(part, whole):
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def with_prf(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of (tp, fp, fn), four places each; f1 from the rounded two."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(F.round(2 * F.col("precision") * F.col("recall") / total, 4)))


def prf(tagged: DataFrame, by=()) -> DataFrame:
    """tagged: (type, outcome tp|fp|fn)."""
    counts = tagged.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])
    return with_prf(counts)


def assign(findings: DataFrame, labels: DataFrame, tolerance: int = 3) -> DataFrame:
    """Outcome rows (file, type, line, outcome): each finding, in order, takes the nearest open label of its file.

    A label fits when it accepts the type and lies within tolerance lines; it is
    taken once; of equally near ones the first by line, then type. A hit counts
    under the label's type, a miss under the finding's. A finding outside the
    labelled files is dropped; one without a line fits nothing, nor does a label
    without one. A task holds a cluster of lines of one file that follow one
    another by tolerance or less: no finding reaches out of it.
    """
    f = findings.join(labels.select("file").distinct(), "file", "left_semi")
    f = f.select("file", "type", F.col("line").cast("int").alias("line"), "ordinal", F.lit(None).cast("array<string>").alias("accepted"), F.lit(False).alias("label"))
    t = labels.where("type is not null").select("file", "type", F.col("line").cast("int").alias("line"), F.lit(None).cast("long").alias("ordinal"), F.col("accepted_types").alias("accepted"), F.lit(True).alias("label"))
    rows = f.unionByName(t)
    placed = line_clusters(rows.where("line is not null"), ("file",), tolerance)
    alone = rows.where("line is null").select("file", "type", "line", F.when(F.col("label"), "fn").otherwise("fp").alias("outcome"))

    def match(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        open_: dict = {}
        for x in sorted((x for x in rows if x["label"]), key=lambda x: (x["line"], x["type"])):
            open_.setdefault(x["line"], []).append((x["type"], set(x["accepted"] or ())))
        out = []
        for x in sorted((x for x in rows if not x["label"]), key=lambda x: (x["ordinal"] is None, x["ordinal"] or 0)):
            near = range(x["line"] - tolerance, x["line"] + tolerance + 1)
            fits = [(abs(n - x["line"]), n, i) for n in near for i, (_, ok) in enumerate(open_.get(n, ())) if x["type"] in ok]
            if fits:
                _, n, i = min(fits)
                out.append((open_[n].pop(i)[0], x["line"], "tp"))
            else:
                out.append((x["type"], x["line"], "fp"))
        out += [(type_, n, "fn") for n, left in open_.items() for type_, _ in left]
        file = group["file"].take(pa.array([0] * len(out), pa.int64()))
        kinds = (("type", pa.string()), ("line", pa.int32()), ("outcome", pa.string()))
        return pa.table({"file": file} | {name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})

    kind = findings.schema["file"].dataType.simpleString()
    return placed.groupBy("file", "_cluster").applyInArrow(match, f"file {kind}, type string, line int, outcome string").unionByName(alone)


def truth_counts(labels: DataFrame) -> DataFrame:
    """(expected, clean files, files) of labels (file, type); a clean file has one row with a null type."""
    per = labels.groupBy("file").agg(F.count("type").alias("n"))
    return per.agg(F.sum("n").alias("expected"), F.count_if(F.col("n") == 0).alias("clean_files"), F.count("*").alias("files"))
