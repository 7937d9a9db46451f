"""Spans and files: which lines lie in which spans, and which paths mean one file.

Spans are met by a sweep over both sides in order, never by pairs: lines and
span edges of a file are dealt into ranges of (file, line), a running maximum of
span ends says whether a line is inside any span, and a count of lines turns a
span into a run of line ranks, which a block of ranks goes through with a stack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from codequarry.functions import text as T
from codequarry.operators import folds


def file_key(location):
    """A location as it is compared: trimmed, forward slashes, no leading ./ or /, lower case; none is empty."""
    return F.lower(T.normal_path(F.trim(F.coalesce(location, F.lit("")))))


def path_suffixes(col):
    """The path and all that is left of it when leading segments go."""
    parts = F.split(col, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def same_path(a: str, b: str) -> bool:
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def same_file(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path) of every file that is a finding's location, ends with it, or is its end.

    Two equi joins on exploded suffixes: a file name that thousands of folders
    have makes no pairs but the right ones.
    """
    c = files.select("path").distinct()
    longer = findings.select("id", F.explode(path_suffixes(F.col("location"))).alias("path")).join(c, "path").select("id", "path")
    shorter = findings.select("id", "location").join(c.select("path", F.explode(path_suffixes(F.col("path"))).alias("location")), "location").select("id", "path")
    return longer.union(shorter).distinct()


def with_root(rows: DataFrame, by: tuple, path: str) -> DataFrame:
    """rows with _root: of all paths of their key that end their path, the shortest.

    Paths of which one ends the other have one root: the shortest that ends the
    longer is no longer than the shorter, so it ends that too. So a root holds all
    rows that may mean one file, though not only those (a/X and b/X meet where X
    alone is a path too).
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(by)] + [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))] + [f"_n{i}" for i in range(len(by))]
    rows = rows.select("*", *keys)
    paths = rows.select(*names, F.col(path).alias("_path")).distinct()
    ends = paths.select(*names, "_path", F.explode(path_suffixes(F.col("_path"))).alias("_root"))
    roots = ends.join(paths.withColumnRenamed("_path", "_root"), [*names, "_root"]).groupBy(*names, "_path").agg(F.min_by("_root", F.length("_root")).alias("_root"))
    return rows.join(roots.withColumnRenamed("_path", path), [*names, path]).drop(*names)


def lines_in_spans(lines: DataFrame, spans: DataFrame, by: tuple) -> DataFrame:
    """Those of the lines (by..., line, ...) that lie in a span (by..., start, end) of their key, ends included."""
    starts = spans.where("start <= end").select(*by, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"))
    points = lines.where("line is not null").select("*", F.col("line").cast("long").alias("_at"), F.lit(1).alias("_kind"))
    swept = folds.running(starts.unionByName(points, allowMissingColumns=True), by, ("_at", "_kind"), {"_reach": (F.max, F.col("_end"))})
    return swept.where("_kind = 1 and _reach >= _at").select(*lines.columns)


def _inside(points: pa.Table, spans: pa.Table) -> pa.Table:
    """What of the open spans each point has, outermost first, each once."""
    points = points.take(pa.array(np.argsort(points["_rank"].to_numpy(), kind="stable")))
    waiting = sorted(zip(*[spans[c].to_pylist() for c in ("start", "_names", "_from", "_to")]), reverse=True)
    open_, out, found, first_end = [], [], [], None
    for rank in points["_rank"].to_pylist():
        changed = False
        while waiting and waiting[-1][2] <= rank:
            open_.append(waiting.pop())
            changed = True
        if changed or (first_end is not None and first_end <= rank):
            open_ = [s for s in open_ if s[3] > rank]
            first_end = min((s[3] for s in open_), default=None)
            found = list(dict.fromkeys(name for s in open_ for name in s[1]))
        out.append(found)
    return points.select(["file", "position"]).append_column("middleware", pa.array(out, pa.list_(pa.string())))


def names_around(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, position, middleware): the names of all spans around each distinct point, outermost first, each once.

    points: (file, position); spans: (file, start, end, middleware), around what
    lies strictly between. A span goes to the blocks of point ranks that it
    covers; in a block a stack of open spans follows the points.
    """
    at = points.select("file", "position").where("position is not null").distinct()
    around = spans.where("start is not null and end is not null and middleware is not null").select("file", "start", "end", F.col("middleware").alias("_names")).distinct()
    edge = lambda column, kind: around.select("file", F.col(column).cast("long").alias("_at"), F.lit(kind).alias("_kind"), "start", "end", "_names")
    # At one place ends come first and starts last, as spans are open.
    events = edge("end", -1).unionByName(edge("start", 1)).unionByName(at.select("file", "position", F.col("position").cast("long").alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    swept = folds.checkpointed(folds.running(events, ("file",), ("_at", "_kind"), {"_rank": (F.sum, F.when(F.col("_kind") == 0, 1).otherwise(0))}))
    width = folds.BLOCK
    runs = swept.where("_kind <> 0").groupBy("file", "start", "end", "_names").agg(F.max(F.when(F.col("_kind") == 1, F.col("_rank"))).alias("_from"), F.max(F.when(F.col("_kind") == -1, F.col("_rank"))).alias("_to"))
    runs = runs.where("_from < _to").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    ranked = swept.where("_kind = 0").select("file", "position", "_rank", F.floor(F.col("_rank") / width).alias("_block"))
    out = StructType([at.schema["file"], at.schema["position"]]).add("middleware", ArrayType(StringType()))
    return ranked.groupBy("file", "_block").cogroup(runs.groupBy("file", "_block")).applyInArrow(_inside, out)
