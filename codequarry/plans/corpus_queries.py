"""Queries of a corpus: events as entries of a route manifest, label rows as samples of files that are documents, parts as file texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.plans.surrogates import pick, sql_pick, table
from codequarry.sources import corpus

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


#: Entries of a manifest; %d is the user, %s the type of the event.
ENTRIES = [
    '{"verb": " post ", "uri": " //u/%d ", "action": "\\\\App\\\\C%d@%s", "middleware": ["web", 7]}',
    '{"uri": "u/%d", "action": "C%d@a@%s", "middleware": "web"}',
    '{"uri": "u/%d", "action": "@%s"}',
    '{"uri": "u/%d", "action": "C%d@"}',
    '{"uri": "u/%d", "action": " "}',
    '{"verb": "%s"}',
    '"%s"',
    '{"verb": "%s", ',
]


def written(template: str, user, kind):
    return F.replace(F.replace(F.lit(template), F.lit("%d"), user.cast("string")), F.lit("%s"), kind)


def manifest_texts(spark, sf):
    """Users as manifests: an entry a line, a list under routes, or a bare list (these without the entries that are no JSON)."""
    e = table(spark, sf, "events")
    shape = F.col("event_id") % 8
    entry = F.coalesce(*[F.when(shape == i, written(t, F.col("user_id"), F.col("event_type"))) for i, t in enumerate(ENTRIES)])
    form = F.col("user_id") % 3
    rows = e.select("user_id", "event_id", entry.alias("entry")).where((form == 0) | (shape != 7))
    texts = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "entry"))), lambda x: x["entry"]).alias("entries"))
    joined = F.array_join("entries", ", ")
    value = F.when(form == 0, F.array_join("entries", "\n\n")).when(form == 1, F.concat(F.lit('{"routes": ['), joined, F.lit("]}"))).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    return texts.select(F.col("user_id").cast("string").alias("file"), value.alias("value"))


MANIFEST = """e AS (SELECT user_id, event_type AS t, event_id % 8 AS shape, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM events WHERE user_id % 3 = 0 OR event_id % 8 <> 7)"""


@query(f"""WITH {MANIFEST} SELECT CAST(user_id AS VARCHAR) AS file, CAST(ordinal AS INT) AS ordinal, CASE shape WHEN 0 THEN 'POST' ELSE 'GET' END AS verb, 'u/' || user_id AS uri,
  CASE shape WHEN 0 THEN 'App\\C' || user_id ELSE 'C' || user_id || '@a' END AS class, t AS method, CASE shape WHEN 0 THEN 'web,7' ELSE '' END AS middleware FROM e WHERE shape < 2""")
def manifest_routes(spark, sf):
    found, _ = corpus.manifest(manifest_texts(spark, sf))
    return found.withColumn("middleware", F.array_join("middleware", ","))


@query(f"""WITH {MANIFEST} SELECT CAST(user_id AS VARCHAR) AS file, CAST(ordinal AS INT) AS ordinal,
  CASE WHEN shape IN (2, 3) THEN 'not Class@method' WHEN shape IN (4, 5) THEN 'no action' ELSE 'not an object' END AS reason FROM e WHERE shape > 1""")
def manifest_rejects(spark, sf):
    _, gone = corpus.manifest(manifest_texts(spark, sf))
    return gone.select("file", "ordinal", "reason")


LABELS = [
    '[{"type": " XSS ", "line": 4, "accepted_types": ["Idor", "xss", " IDOR "]}]',
    '[{"type": "idor", "line": "x", "engine": " Rules "}, {"type": ""}, 5]',
    "[]",
    '"none"',
]


def samples(spark, sf):
    """Label rows as samples: of ten files one is not there, of eleven samples one names none; four kinds of labels."""
    d = F.col("doc_id")
    name = F.when(d % 11 == 5, "").when(d % 10 == 3, F.concat(F.lit("gone/"), d.cast("string"))).otherwise(d.cast("string"))
    value = F.concat(F.lit('{"file": "'), name, F.lit('", "expected": '), pick(LABELS, F.col("quality") * 2 + F.col("toxic")), F.lit("}"))
    files = table(spark, sf, "documents").select(d.cast("string").alias("path"))
    return corpus.labels(table(spark, sf, "labels").select(F.concat(F.lit("t"), (d % 5).cast("string")).alias("file"), value.alias("value")), files)


SAMPLES = """s AS (SELECT doc_id, quality * 2 + toxic AS kind, CASE WHEN doc_id % 11 = 5 THEN 'no file' WHEN doc_id % 10 = 3 THEN 'no such file' END AS reason FROM labels)"""


@query(f"""WITH {SAMPLES} SELECT CAST(doc_id AS VARCHAR) AS file, CASE kind WHEN 0 THEN 'xss' WHEN 1 THEN 'idor' END AS type, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 0 END AS line,
  CASE kind WHEN 0 THEN 'ai' WHEN 1 THEN 'rules' END AS engine, CASE kind WHEN 0 THEN 'xss,idor' WHEN 1 THEN 'idor' END AS accepted FROM s WHERE reason IS NULL""")
def corpus_labels(spark, sf):
    found, _ = samples(spark, sf)
    return found.select("file", "type", "line", "engine", F.array_join("accepted_types", ",").alias("accepted"))


@query(f"""WITH {SAMPLES} SELECT 't' || (doc_id % 5) AS source, CAST(NULL AS INT) AS item, reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 't' || (doc_id % 5), i, ['no type', 'label is not an object'][i], count(*) FROM s, (VALUES (1), (2)) v(i) WHERE reason IS NULL AND kind = 1 GROUP BY ALL""")
def corpus_rejects(spark, sf):
    _, gone = samples(spark, sf)
    return gone.groupBy("source", "item", "reason").agg(F.count("*").alias("n"))


TEXTS = ["class A extends\n  Controller {}", "class A extends ControllerBase {}", "class A extends Model implements B {}", "// extends FormRequest\nclass A {}", "class A extends Middleware{}", "class A extends Base\\Controller {}"]
KINDS = ["controller", "other", "model", "request", "middleware", "other"]


@query(f"SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'route' ELSE {sql_pick(KINDS, 'p_partkey % 6')} END AS type FROM part")
def corpus_types(spark, sf):
    path = F.concat(F.when(F.col("p_size") % 4 == 0, "app/routes/").otherwise("app/"), F.col("p_partkey").cast("string"), F.lit(".php"))
    return table(spark, sf, "part").select("p_partkey", corpus.type_by_patterns(path, pick(TEXTS, F.col("p_partkey") % 6)).alias("type"))
