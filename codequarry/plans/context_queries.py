"""Queries of chunk context: orders are chunks, their lines files, parts controllers with routes, suppliers requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators import context as C
from codequarry.plans.surrogates import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
BUDGETS = (25, 70, 0)


def text(x):
    return x.cast("string") if not isinstance(x, str) else F.lit(x)


def joined(*parts):
    return F.concat(*map(text, parts))


def files(spark, sf):
    """Lines of orders as files: one of four is a model, one a service, two are controllers that take a request."""
    n, part, supp = F.col("l_linenumber") % 4, F.col("l_partkey"), F.col("l_suppkey")
    kind = F.when(n == 0, "model").when(n == 1, "service").otherwise("controller")
    name = F.when(n == 0, joined("App\\Models\\M", part % 11)).when(n > 1, joined("App\\Http\\Controllers\\C", part))
    request = joined("R", supp % 7)
    content = joined(
        "<?php\nuse App\\Models\\M", (part + 1) % 11, ";\nuse App\\Models\\M", supp % 11, ";\nuse Old\\", request, ";\nuse App\\Http\\Requests\\", request, ";\nuse App\\Services\\Clock;\n",
        "class X {\n  function store(\n    ?", request, " $r, int $n) {}\n  function show(Clock $c, string $id) {}\n  function again(", request, " $r) {}\n}\n",
    )
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    rows = table(spark, sf, "lineitem").select("l_orderkey", *ORDER).withColumn("at", at)  # before texts are made, so that none are sorted
    return rows.select(F.col("l_orderkey").alias("chunk"), F.col("at").alias("ordinal"), kind.alias("type"), name.alias("class"), content.alias("content"))


def routes(spark, sf):
    """0 to 2 routes a part, by brand, so that controllers share them."""
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("ordinal"))
    middleware = F.array_compact(F.array(F.lit("web"), F.when(F.col("p_size") % 2 > 0, "auth"), F.when(F.col("p_size") % 5 > 2, "signed")))
    route = joined("GET /", F.lower("p_brand"), "/", F.col("ordinal"))
    return rows.where("ordinal <= p_size % 3").select(joined("App\\Http\\Controllers\\C", F.col("p_partkey")).alias("class"), route.alias("route"), middleware.alias("middleware"), "ordinal")


def methods(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("ordinal"))
    route = joined("GET|HEAD /", F.lower("p_brand"), "/", F.col("ordinal"))
    return rows.where("ordinal <= p_size % 3").select(joined("App\\Http\\Controllers\\C", F.col("p_partkey")).alias("class"), joined("act", F.col("ordinal")).alias("method"), route.alias("route"), "ordinal")


def known(spark, sf) -> DataFrame:
    """The entries of all sections; one request and one model are not there."""
    r = table(spark, sf, "supplier").select((F.col("s_suppkey") % 7).alias("n")).distinct().where("n <> 3")
    body = joined("class R", F.col("n"), " ", F.repeat(F.lit("x"), (F.col("n") * 9).cast("int")))
    requests = r.select(joined("App\\Http\\Requests\\R", F.col("n")).alias("class"), joined("app/Http/Requests/R", F.col("n"), ".php").alias("path"), body.alias("content"))
    m = table(spark, sf, "part").select((F.col("p_partkey") % 11).alias("n")).distinct().where("n <> 5")
    cast = F.struct(F.lit("at").alias("name"), F.lit("datetime").alias("cast"))
    fields = [F.array(joined("f", F.col("n"))).alias("fillable"), F.array(F.lit("secret")).alias("hidden"), F.array().cast("array<string>").alias("guarded")]
    casts = F.when(F.col("n") % 2 > 0, F.array(cast)).otherwise(F.array().cast("array<struct<name:string,cast:string>>"))
    models = m.select(joined("App\\Models\\M", F.col("n")).alias("class"), *fields, casts.alias("casts"))
    return C.entries(routes(spark, sf), methods(spark, sf), requests, models)


FILES = f"""l AS (SELECT l_orderkey AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS pos, l_linenumber % 4 AS kind, l_partkey AS p, l_suppkey AS s FROM lineitem)"""
ROUTES = """r AS (SELECT p_partkey AS p, j, 'GET /' || lower(p_brand) || '/' || j AS route, 'GET|HEAD /' || lower(p_brand) || '/' || j AS reached,
  concat_ws(', ', 'web', CASE WHEN p_size % 2 > 0 THEN 'auth' END, CASE WHEN p_size % 5 > 2 THEN 'signed' END) AS middleware FROM part, (VALUES (1), (2)) v(j) WHERE j <= p_size % 3)"""
#: Entries a chunk asks for; what a key is at last, where it stands first.
ASKED = f"""{FILES}, {ROUTES},
q AS (SELECT chunk, 1 AS sec, route AS key, pos, 0 AS n, j, '- ' || route || ': ' || middleware AS t FROM l JOIN r USING (p) WHERE kind > 1
  UNION ALL SELECT chunk, 2, 'act' || j, pos, 0, j, '- act' || j || '(): ' || reached FROM l JOIN r USING (p) WHERE kind > 1
  UNION ALL SELECT chunk, 3, 'App\\Http\\Requests\\R' || (s % 7), pos, 0, 0, '### app/Http/Requests/R' || (s % 7) || '.php' || chr(10) || '```php' || chr(10) || 'class R' || (s % 7) || ' ' || repeat('x', CAST(s % 7 * 9 AS INT)) || chr(10) || '```'
    FROM l WHERE kind > 1 AND s % 7 <> 3 AND s % 7 IN (SELECT s_suppkey % 7 FROM supplier)
  UNION ALL SELECT chunk, 4, 'App\\Models\\M' || m, pos, n, 0, '### App\\Models\\M' || m || chr(10) || '- $fillable: [''f' || m || ''']' || chr(10) || '- $hidden: [''secret'']' || chr(10) || '- $guarded: []' || CASE WHEN m % 2 > 0 THEN chr(10) || '- $casts: [''at'' => ''datetime'']' ELSE '' END
    FROM (SELECT chunk, pos, 0 AS n, p % 11 AS m FROM l WHERE kind = 0 UNION ALL SELECT chunk, pos, 0, (p + 1) % 11 FROM l WHERE kind > 0 UNION ALL SELECT chunk, pos, 1, s % 11 FROM l WHERE kind > 0)
    WHERE m <> 5 AND m IN (SELECT p_partkey % 11 FROM part)),
u AS (SELECT chunk, sec, key, min((pos, n, j)) AS first, arg_max(t, (pos, n, j)) AS t FROM q GROUP BY chunk, sec, key),
k AS (SELECT chunk, sec, key, t, CAST(ceil(strlen(t) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY chunk ORDER BY sec, first, key) AS place FROM u)"""
#: A budget's fold over the places of a chunk.
FOLDED = f"""b AS (SELECT unnest({list(BUDGETS)}) AS budget),
f(budget, chunk, place, used, took) AS (
  SELECT budget, chunk, place, CASE WHEN budget = 0 OR tokens <= budget THEN tokens ELSE 0 END, budget = 0 OR tokens <= budget FROM k, b WHERE place = 1
  UNION ALL SELECT f.budget, k.chunk, k.place, f.used + CASE WHEN f.budget = 0 OR f.used + k.tokens <= f.budget THEN k.tokens ELSE 0 END, f.budget = 0 OR f.used + k.tokens <= f.budget
  FROM f JOIN k ON k.chunk = f.chunk AND k.place = f.place + 1)"""


@query(f"WITH RECURSIVE {ASKED}, {FOLDED} SELECT budget, chunk, CAST(place AS INT) AS place, ['routes', 'methods', 'requests', 'models'][sec] AS section, key, tokens FROM f JOIN k USING (chunk, place) WHERE took")
def chunk_context(spark, sf):
    """What chunks take under three budgets."""
    entries = C.ranked(files(spark, sf), known(spark, sf), ("chunk",))
    return C.within(entries, BUDGETS, ("chunk",)).select("budget", "chunk", "place", "section", "key", "tokens")


SQL_SECTIONS = ", ".join(
    f"CASE WHEN count(*) FILTER (sec = {i}) > 0 THEN '{head}' || chr(10) || string_agg(t, chr(10) ORDER BY place) FILTER (sec = {i}){f" || chr(10) || '{foot}'" if foot else ''} END"
    for i, (head, foot) in enumerate(C.SECTIONS.values(), 1)
)


@query(f"WITH RECURSIVE {ASKED}, {FOLDED} SELECT chunk, md5(concat_ws(chr(10) || chr(10), {SQL_SECTIONS}) || chr(10)) AS context, CAST(sum(tokens) AS BIGINT) AS tokens FROM f JOIN k USING (chunk, place) WHERE took AND budget = {BUDGETS[1]} GROUP BY chunk")
def chunk_context_text(spark, sf):
    """The rendered context of each chunk under the middle budget."""
    out = C.rendered(C.chosen(files(spark, sf), known(spark, sf), BUDGETS[1], ("chunk",)), ("chunk",))
    return out.select("chunk", F.md5(F.col("context").cast("binary")).alias("context"), "tokens")


@query(f"""WITH {FILES}, {ROUTES}, c AS (SELECT DISTINCT p FROM l WHERE kind > 1)
SELECT 'App\\Http\\Controllers\\C' || a.p AS class, 'act' || a.j AS method, a.reached AS route,
  coalesce((SELECT arg_min(b.middleware, b.j) FROM r b WHERE b.p = a.p AND contains(b.route, substring(a.reached, 10))), '') AS middleware FROM r a JOIN c USING (p)""")
def access_context(spark, sf):
    """Routed methods of controllers with the middleware of their routes."""
    out = C.routed_middleware(files(spark, sf), methods(spark, sf).select("class", "method", "route"), routes(spark, sf))
    return out.select("class", "method", "route", F.array_join("middleware", ", ").alias("middleware"))
