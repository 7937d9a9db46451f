"""JSON inputs: routes, ground truth, history, usage, baseline. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import schemas
from codequarry.functions import text as T


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, value, r): objects of JSON files, whether one object, a list of them or one a line; r has _corrupt_record.

    A missing path gives no rows.
    """
    whole = schema + ", _corrupt_record string"
    try:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "value string, file string")
    lines = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")
    by_line = F.forall(lines, lambda x: x.startswith("{") & x.endswith("}"))
    listed = F.from_json("value", "array<string>")
    parts = F.when(by_line, lines).when(F.trim("value").startswith("[") & listed.isNotNull(), listed).otherwise(F.array("value"))
    rows = files.select("file", F.explode(parts).alias("value"))
    return rows.select("file", "value", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What _parsed gives, without what cannot be parsed."""
    return _parsed(spark, path, schema).where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, value) of what cannot be parsed: a bad row by itself, or a file whose layout is none of the three as a whole."""
    return _parsed(spark, path, schema).where("(r is null or r._corrupt_record is not null) and value rlike '\\\\S'").select("file", "value")


def routes(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows (verb, uri, class, method, middleware); an action without @ fails the query."""
    r = _json(spark, path, schemas.ROUTE)
    ok = F.when(F.col("action").rlike(r"^[\\\w]+@\w+$"), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("route action must be Class@method: "), F.coalesce("action", F.lit("null")))))
    return r.withColumn("action", ok).select("verb", "uri", F.ltrim(F.substring_index("action", "@", 1), F.lit("\\")).alias("class"), F.substring_index("action", "@", -1).alias("method"), F.coalesce("middleware", F.array().cast("array<string>")).alias("middleware"))


def ground_truth(spark: SparkSession, path: str, engine: str | None = None) -> DataFrame:
    """(file, type, line, engine, accepted_types, line_tolerance); clean files keep one row with a null type."""
    doc = _json(spark, path, schemas.GROUND_TRUTH).select(F.coalesce("line_tolerance", F.lit(3)).alias("line_tolerance"), F.explode("samples").alias("s"))
    word = lambda c: F.lower(F.trim(c))
    wanted = F.coalesce("s.expected", F.expr("cast(array() as array<struct<type:string,line:int,engine:string,accepted_types:array<string>>>)"))
    if engine:
        wanted = F.filter(wanted, lambda e: F.coalesce(e["engine"], F.lit("ai")) == engine)
    rows = doc.select("line_tolerance", "s.file", F.explode_outer(wanted).alias("e"))
    accepted = F.array_distinct(F.array_union(F.array(word(F.col("e.type"))), F.transform(F.coalesce("e.accepted_types", F.array().cast("array<string>")), word)))
    return rows.select("file", word(F.col("e.type")).alias("type"), "e.line", F.when(F.col("e.type").isNotNull(), F.coalesce("e.engine", F.lit("ai"))).alias("engine"), F.when(F.col("e.type").isNotNull(), accepted).alias("accepted_types"), "line_tolerance")


def history(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.HISTORY)


def kept_scans(spark: SparkSession, path: str) -> DataFrame:
    """Heads of a saved history that have not been deleted."""
    gone = _json(spark, f"{path}/deleted", "id string").distinct()
    return history(spark, f"{path}/scans").join(gone, "id", "left_anti")


def kept_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the scans of a saved history that have not been deleted."""
    gone = _json(spark, f"{path}/deleted", "id string").distinct()
    return _json(spark, f"{path}/findings", f"id string, {schemas.SAVED_FINDING}").join(gone, "id", "left_anti")


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.USAGE).withColumn("at", F.to_timestamp("timestamp"))


def set_aside_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): what has been set aside of a log."""
    return _json(spark, path, "file string, value string")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries that can match something; malformed ones are dropped."""
    return _json(spark, path, schemas.BASELINE).where("fingerprint is not null or (file is not null and type is not null and hash is not null)")


def prices(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.PRICE).withColumn("ordinal", F.monotonically_increasing_id())


def usage_tokens(raw: DataFrame, column: str = "usage") -> DataFrame:
    """prompt_tokens and completion_tokens under either of their two spellings."""
    get = lambda *names: F.coalesce(*[F.get_json_object(column, f"$.{n}").cast("long") for n in names], F.lit(0).cast("long"))
    return raw.withColumn("prompt_tokens", get("prompt_tokens", "input_tokens", "promptTokens")).withColumn("completion_tokens", get("completion_tokens", "output_tokens", "completionTokens"))


def normal_locations(df: DataFrame) -> DataFrame:
    return df.withColumn("location", T.normal_path(F.col("location")))
