"""Queries of greedy choices in report order: near copies, two sources, ground truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.operators import benchmark, catalogue
from codequarry.operators import findings as O
from codequarry.plans.surrogates import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag")


def reported(spark, sf):
    """Findings of one supplier are a scan, of one status a file; lines and words by part and month, in order of lineitem."""
    order = Window.partitionBy("l_suppkey").orderBy(*ORDER)
    type_ = F.when(F.col("l_returnflag") == "A", "idor").when(F.col("l_returnflag") == "N", "auth_bypass").otherwise("xss")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scan_id"),
        type_.alias("type"),
        F.col("l_linestatus").alias("location"),
        (F.col("l_partkey") % 400).cast("int").alias("line"),
        F.lit("").alias("proof"),
        F.concat(F.lit("Month  "), F.month("l_shipdate") % 3).alias("description"),
        F.row_number().over(order).cast("long").alias("ordinal"),
        "l_discount",
    )


REPORTED = f"""o AS (SELECT l_suppkey AS scan_id, CASE l_returnflag WHEN 'A' THEN 'idor' WHEN 'N' THEN 'auth_bypass' ELSE 'xss' END AS type,
  CASE WHEN l_returnflag IN ('A', 'N') THEN 'access_control' ELSE 'xss' END AS kind, l_linestatus AS location, CAST(l_partkey % 400 AS INT) AS line,
  'month ' || (month(l_shipdate) % 3) AS said, l_discount, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ORDER)}) AS ordinal FROM lineitem)"""


@query(f"""WITH RECURSIVE {REPORTED},
g AS (SELECT *, row_number() OVER (PARTITION BY scan_id, kind, location ORDER BY ordinal) AS n FROM o),
w(scan_id, kind, location, n, kept) AS (
  SELECT DISTINCT scan_id, kind, location, CAST(0 AS BIGINT), CAST([] AS STRUCT(line INT, said VARCHAR)[]) FROM g
  UNION ALL SELECT g.scan_id, g.kind, g.location, g.n,
    CASE WHEN len(list_filter(w.kept, lambda x: x.line = g.line OR (abs(x.line - g.line) <= 2 AND x.said = g.said))) > 0 THEN w.kept ELSE list_append(w.kept, {{'line': g.line, 'said': g.said}}) END
  FROM w JOIN g ON g.scan_id = w.scan_id AND g.kind = w.kind AND g.location = w.location AND g.n = w.n + 1),
k AS (SELECT scan_id, kind, location, unnest(kept) AS x FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, kind, location ORDER BY n DESC) AS last FROM w) WHERE last = 1)
SELECT scan_id, kind, location, x.line AS line, x.said AS said FROM k""")
def near_dedupe(spark, sf):
    kept = O.drop_near(reported(spark, sf))
    said = F.lower(F.regexp_replace("description", r"\s+", " "))
    return kept.select("scan_id", O.token().alias("kind"), "location", "line", said.alias("said"))


@query(f"""WITH RECURSIVE {REPORTED},
old AS (SELECT * FROM o WHERE l_discount < 0.02),
new AS (SELECT * FROM o WHERE l_discount >= 0.02 AND NOT EXISTS (SELECT 1 FROM old WHERE old.scan_id = o.scan_id AND old.kind = o.kind AND old.location = o.location AND abs(old.line - o.line) <= 5)),
g AS (SELECT *, row_number() OVER (PARTITION BY scan_id, kind, location ORDER BY ordinal) AS n FROM new),
w(scan_id, kind, location, n, kept) AS (
  SELECT DISTINCT scan_id, kind, location, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM g
  UNION ALL SELECT g.scan_id, g.kind, g.location, g.n, CASE WHEN len(list_filter(w.kept, lambda x: abs(x // 1000000 - g.line) <= 5)) > 0 THEN w.kept ELSE list_append(w.kept, g.line * 1000000 + g.ordinal) END
  FROM w JOIN g ON g.scan_id = w.scan_id AND g.kind = w.kind AND g.location = w.location AND g.n = w.n + 1),
k AS (SELECT scan_id, unnest(kept) % 1000000 AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, kind, location ORDER BY n DESC) AS last FROM w) WHERE last = 1)
SELECT scan_id, type, location, line, ordinal FROM old UNION ALL SELECT o.scan_id, o.type, o.location, o.line, o.ordinal FROM o JOIN k USING (scan_id, ordinal)""")
def merge_sources(spark, sf):
    """Two sources of one scan: the second's findings join where nothing of their kind is near."""
    all_ = reported(spark, sf)
    merged = O.merge(all_.where("l_discount >= 0.02"), all_.where("l_discount < 0.02"))
    return merged.select("scan_id", "type", "location", "line", "ordinal")


@query(f"""WITH RECURSIVE {REPORTED},
t AS (SELECT scan_id AS file, type, line, row_number() OVER (PARTITION BY scan_id ORDER BY line, type) AS id FROM (SELECT DISTINCT scan_id, type, line FROM o WHERE l_discount < 0.02)),
f AS (SELECT scan_id AS file, type, line, row_number() OVER (PARTITION BY scan_id ORDER BY ordinal) AS n FROM o WHERE l_discount >= 0.02 AND scan_id IN (SELECT file FROM t)),
w(file, n, open, type, line, outcome) AS (
  SELECT file, CAST(0 AS BIGINT), list({{'line': line, 'type': type, 'id': id}}), '', 0, '' FROM t GROUP BY file
  UNION ALL SELECT file, n, CASE WHEN hit IS NULL THEN open ELSE list_filter(open, lambda x: x.id <> hit.id) END, CASE WHEN hit IS NULL THEN type ELSE hit.type END, line, CASE WHEN hit IS NULL THEN 'fp' ELSE 'tp' END FROM (
    SELECT f.file, f.n, w.open, f.type, f.line, list_sort(list_transform(list_filter(w.open, lambda x: abs(x.line - f.line) <= 3 AND (x.type = f.type OR (x.type = 'idor' AND f.type = 'auth_bypass'))), lambda x: {{'far': abs(x.line - f.line), 'id': x.id, 'type': x.type}}))[1] AS hit
    FROM w JOIN f ON f.file = w.file AND f.n = w.n + 1)),
l AS (SELECT file, unnest(open) AS x FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC) AS last FROM w) WHERE last = 1)
SELECT CAST(file AS VARCHAR) AS file, type, line, outcome FROM w WHERE n > 0 UNION ALL SELECT CAST(file AS VARCHAR), x.type, x.line, 'fn' FROM l""")
def label_assign(spark, sf):
    """Findings against labels of their file; labels of one type accept another."""
    all_ = reported(spark, sf).withColumn("file", F.col("scan_id").cast("string"))
    accepted = F.when(F.col("type") == "idor", F.array(F.lit("idor"), F.lit("auth_bypass"))).otherwise(F.array("type"))
    labels = all_.where("l_discount < 0.02").select("file", "type", "line").distinct().withColumn("accepted_types", accepted)
    return benchmark.assign(all_.where("l_discount >= 0.02"), labels)


PLACED = """f AS (SELECT l_suppkey AS scan_id, l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag, CAST(l_orderkey % 900 AS INT) AS line,
  ['', 'app/', 'repo/app/', 'Repo/App/', 'other/'][CAST(l_partkey % 5 AS INT) + 1] || 'F' || (l_partkey // 5 % 8) || '.php' AS location FROM lineitem)"""
SAME_FILE = "(lower(a.location) = lower(b.location) OR suffix(lower(a.location), '/' || lower(b.location)) OR suffix(lower(b.location), '/' || lower(a.location)))"


def placed(spark, sf):
    """Findings whose files are given from different folders: a bare name, below app, below repo/app, in another case."""
    folder = F.element_at(F.array(*[F.lit(x) for x in ("", "app/", "repo/app/", "Repo/App/", "other/")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    name = F.concat(folder, F.lit("F"), (F.floor(F.col("l_partkey") / 5) % 8).cast("string"), F.lit(".php"))
    line = (F.col("l_orderkey") % 900).cast("int").alias("line")
    found = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("scan_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"), line, name.alias("location"))
    return found.withColumn("type", F.lit("xss"))


@query(f"""WITH {PLACED} SELECT scan_id, l_orderkey, l_linenumber, l_partkey, location, line FROM f a WHERE flag <> 'A'
  AND NOT EXISTS (SELECT 1 FROM f b WHERE b.flag = 'A' AND b.scan_id = a.scan_id AND abs(a.line - b.line) <= 5 AND {SAME_FILE})""")
def merge_by_suffix(spark, sf):
    """Findings of one source with none of the other near them, in files that the two name from different folders."""
    found = placed(spark, sf)
    left = O.not_near(found.where("flag <> 'A'"), found.where("flag = 'A'"))
    return left.select("scan_id", "l_orderkey", "l_linenumber", "l_partkey", "location", "line")


@query(f"""WITH {PLACED} SELECT scan_id, l_orderkey, l_linenumber, l_partkey, location, line FROM f a WHERE flag <> 'A'
  AND NOT EXISTS (SELECT 1 FROM f b WHERE b.flag = 'A' AND b.scan_id = a.scan_id AND a.line BETWEEN b.line AND b.line + 9 AND {SAME_FILE})""")
def spans_by_suffix(spark, sf):
    """Findings outside the spans of methods in files that are named from different folders."""
    found = placed(spark, sf)
    spans = found.where("flag = 'A'").select("scan_id", "location", F.col("line").alias("start"), (F.col("line") + 9).alias("end"))
    left = O.outside_spans(found.where("flag <> 'A'"), spans, ("scan_id", "location"))
    return left.select("scan_id", "l_orderkey", "l_linenumber", "l_partkey", "location", "line")


@query("""WITH k AS (SELECT key, row_number() OVER (ORDER BY key) AS ordinal FROM (SELECT DISTINCT 'GET /' || lower(p_type) || '/' || lower(p_brand) AS key FROM part)),
r AS (SELECT DISTINCT 'POST ' || substring(lower(p_type), 1 + CAST(p_size % 4 AS INT), 4) || '/' || substring(lower(p_brand), 1, 3 + CAST(p_size % 5 AS INT)) AS route FROM part UNION SELECT 'GET ' UNION SELECT 'nowhere'),
w AS (SELECT route, trim(regexp_extract(' ' || route, '[^ ]*$')) AS word FROM r)
SELECT w.route, coalesce(arg_min(k.key, k.ordinal), '') AS middleware FROM w LEFT JOIN k ON contains(k.key, w.word) GROUP BY w.route""")
def middleware_by_substring(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    keys = p.select(F.concat(F.lit("GET /"), F.lower("p_type"), F.lit("/"), F.lower("p_brand")).alias("key")).distinct()
    known = keys.select("key", F.row_number().over(Window.orderBy("key")).alias("ordinal"), F.array("key").alias("middleware"))
    begun = F.concat(F.substring(F.lower("p_type"), 1 + size % 4, F.lit(4)), F.lit("/"), F.substring(F.lower("p_brand"), F.lit(1), 3 + size % 5))
    routes = p.select(F.concat(F.lit("POST "), begun).alias("route")).distinct().union(spark.createDataFrame([("GET ",), ("nowhere",)], "route string"))
    return catalogue.middleware_of(routes, known).select("route", F.array_join("middleware", ",").alias("middleware"))


@query("""WITH c AS (SELECT p_partkey AS id, 'App\\Models\\' || p_type AS a, 'App\\Http\\Requests\\' || p_brand AS b FROM part),
f AS (SELECT DISTINCT 'app/Models/' || p_type || '.php' AS used FROM part WHERE p_size > 10 UNION SELECT DISTINCT 'app/Http/Requests/' || p_brand || '.php' FROM part WHERE p_size < 40),
n AS (SELECT id, a AS class, 'app/' || replace(substring(a, 5), '\\', '/') || '.php' AS used FROM c UNION SELECT id, b, 'app/' || replace(substring(b, 5), '\\', '/') || '.php' FROM c)
SELECT 'app/C' || id || '.php' AS path, class, used FROM n JOIN f USING (used) WHERE regexp_full_match(class, '[A-Za-z0-9_\\\\]+')""")
def controller_files(spark, sf):
    p = table(spark, sf, "part")
    content = F.concat(F.lit("<?php\nuse App\\Models\\"), "p_type", F.lit(" as M;\nuse Other\\Thing;\nclass C { function store(\\App\\Http\\Requests\\"), "p_brand", F.lit(" $r, int $n) {} }"))
    controllers = p.select(F.concat(F.lit("app/C"), F.col("p_partkey").cast("string"), F.lit(".php")).alias("path"), content.alias("content"))
    models = p.where("p_size > 10").select(F.concat(F.lit("app/Models/"), "p_type", F.lit(".php")).alias("path"))
    requests = p.where("p_size < 40").select(F.concat(F.lit("app/Http/Requests/"), "p_brand", F.lit(".php")).alias("path"))
    return catalogue.used_files(controllers, models.union(requests))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY path) AS INT) AS place FROM (SELECT doc_id, source, lang || '/' || md5(CAST(doc_id AS VARCHAR)) AS path FROM documents)")
def file_order(spark, sf):
    """Files of a scan by path, in the order of code points."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.concat("lang", F.lit("/"), F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("path"))
    return d.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("path")).alias("place"))
