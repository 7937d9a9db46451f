"""A benchmark corpus: its files, its route manifest and its labels; what cannot be used is kept as rows with a reason."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import rules
from codequarry.functions import text as T
from codequarry.operators.responses import kind_of, whole_json
from codequarry.sources.files import TargetError, classified

ENGINE, TOLERANCE = "ai", 3


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): JSON files as whole texts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def listed(raw: DataFrame, key: str) -> DataFrame:
    """(file, ordinal, value, entry) of the entries of JSON texts, entry a variant.

    A text is an object that holds a list under key, a list, one entry, or an
    entry a line. An entry that is no JSON is null; key with anything but a list
    is one entry, the object itself. Ordinals count within a text. Null and empty
    texts have no entries.
    """
    whole = whole_json(F.col("value"))
    entries = F.coalesce(F.try_variant_get(whole, f"$.{key}", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    lines = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")
    pair = lambda text, entry: F.struct(text.alias("value"), entry.alias("entry"))
    items = (
        F.when(entries.isNotNull(), F.transform(entries, lambda x: pair(F.to_json(x), x)))
        .when(whole.isNotNull(), F.array(pair(F.col("value"), whole)))
        .otherwise(F.transform(lines, lambda x: pair(x, whole_json(x))))
    )
    return raw.select("file", F.posexplode(items).alias("ordinal", "_item")).select("file", "ordinal", "_item.*")


def _text(entry: str, key: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(entry, f"$.{key}", "string"), F.lit("")))


def _is_object(entry) -> Column:
    return F.coalesce(kind_of(entry) == "OBJECT", F.lit(False))


def manifest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes (file, ordinal, verb, uri, class, method, middleware) and rejects (file, ordinal, value, reason) of (file, value) texts.

    An action is Class@method, split at the last @; a leading backslash of the
    class and leading slashes of the uri go. A verb that is not given is GET; a
    middleware that is no list counts as none.
    """
    action, verb = _text("entry", "action"), F.try_variant_get("entry", "$.verb", "string")
    split = lambda group: F.regexp_extract(action, r"(?s)^(.+)@([^@]+)$", group)
    reason = F.when(~_is_object("entry"), "not an object").when(action == "", "no action").when(split(2) == "", "not Class@method")
    rows = listed(raw, "routes").withColumn("reason", reason)
    middleware = F.coalesce(F.try_variant_get("entry", "$.middleware", "array<string>"), F.array().cast("array<string>"))
    found = rows.where("reason is null").select(
        "file", "ordinal", F.upper(F.trim(F.coalesce(verb, F.lit("GET")))).alias("verb"), F.ltrim(_text("entry", "uri"), F.lit("/")).alias("uri"),
        F.ltrim(split(1), F.lit("\\")).alias("class"), split(2).alias("method"), middleware.alias("middleware"),
    )
    return found, rows.where("reason is not null").select("file", "ordinal", "value", "reason")


def labels(raw: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (file, type, line, engine, accepted_types) and rejects (source, ordinal, item, value, reason) of (file, value) texts.

    A sample is an object with file and expected, a list of labels; one without
    labels is clean and keeps a row with a null type. With files (path), samples
    of files that are not there are rejects. A label needs a type; a line that is
    no number counts as 0, an engine that is not given as the default one. The
    type itself is always accepted, first, the others as they come, once each.
    """
    samples = listed(raw, "samples").withColumnRenamed("file", "source").withColumn("file", _text("entry", "file"))
    reason = F.when(~_is_object("entry"), "not an object").when(F.col("file") == "", "no file")
    if files is not None:
        there = files.select(F.col("path").alias("file"), F.lit(True).alias("_there")).distinct()
        samples = samples.join(there, "file", "left")
        reason = reason.when(F.col("_there").isNull(), "no such file")
    samples = samples.withColumn("reason", reason)
    gone = samples.where("reason is not null").select("source", "ordinal", F.lit(None).cast("int").alias("item"), "value", "reason")
    expected = F.try_variant_get("entry", "$.expected", "array<variant>")
    kept = samples.where("reason is null").select("source", "ordinal", "file", F.posexplode_outer(expected).alias("item", "e"))
    type_, engine = F.lower(_text("e", "type")), F.lower(_text("e", "engine"))
    kept = kept.withColumn("type", F.when(F.col("item").isNotNull(), type_)).withColumn("reason", F.when(~_is_object("e"), "label is not an object").when(F.col("type") == "", "no type"))
    bad = (F.col("item").isNotNull()) & F.col("reason").isNotNull()
    others = F.transform(F.coalesce(F.try_variant_get("e", "$.accepted_types", "array<string>"), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    labelled = F.col("item").isNotNull()
    found = kept.where(~bad).select(
        "file", "type", F.when(labelled, F.coalesce(F.try_variant_get("e", "$.line", "int"), F.lit(0))).alias("line"),
        F.when(labelled, F.when(engine == "", ENGINE).otherwise(engine)).alias("engine"),
        F.when(labelled, F.array_distinct(F.concat(F.array("type"), F.filter(others, lambda x: x.isNotNull())))).alias("accepted_types"),
    )
    return found, gone.union(kept.where(bad).select("source", "ordinal", "item", F.to_json("e").alias("value"), "reason"))


def type_by_patterns(path: Column, content: Column) -> Column:
    """Kind of a corpus file by its folder, else by what its text extends, comments included."""
    kinds = {"Controller": "controller", "Model": "model", "Middleware": "middleware", "FormRequest": "request"}
    out = F.when(path.contains("routes/"), "route")
    for parent, kind in kinds.items():
        out = out.when(content.rlike(rf"extends\s+{parent}\b"), kind)
    return out.otherwise("other")


def corpus(spark: SparkSession, root: str, patterns: bool = False) -> DataFrame:
    """(path, content, type) of all PHP files below root, in order of path.

    Unlike a scan it leaves nothing out. Types come from declarations, as those
    of a scan do, or from type_by_patterns().
    """
    if "://" not in root and not os.path.isdir(root):
        raise TargetError(f"no such folder: {root}")
    raw = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.php").load(root)
    base = root.rstrip("/") if "://" in root else os.path.realpath(root)
    full = F.col("path") if "://" in root else F.regexp_replace("path", "^file:/*", "/")
    files = raw.where(~rules.binary(F.col("content"))).select(T.normal_path(full, base).alias("path"), F.col("content").cast("string").alias("content"))
    typed = files.withColumn("type", type_by_patterns(F.col("path"), F.col("content"))) if patterns else classified(files)
    return typed.select("path", "content", "type").orderBy("path")


def unlabelled(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files that no label and no clean sample names."""
    return files.join(found.select(F.col("file").alias("path")), "path", "left_anti")
