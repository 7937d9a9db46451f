"""Queries over the code catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import catalogue as C
from codequarry.plans.surrogates import FINDINGS, findings, pick, sql_pick, table
from codequarry.registry import RESOURCE_ROUTES, sql_values

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH a AS (SELECT l_orderkey % 3000 AS m, l_linenumber AS line, max(l_partkey) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), u AS (SELECT l_orderkey % 3000 AS m, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R')
SELECT u.m AS method, u.line, a.v AS value FROM u ASOF LEFT JOIN a ON u.m = a.m AND u.line >= a.line""")
def asof_assignment(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3000).alias("method"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("value"), "l_returnflag")
    return C.latest_before(li.where("l_returnflag = 'R'").select("method", "line"), li.where("l_returnflag = 'A'").select("method", "line", "value"), ("method",), "line", "value")


@query("WITH RECURSIVE parents AS (SELECT p_partkey AS child, CASE WHEN p_partkey > 0 THEN p_partkey // 10 END AS parent FROM part), up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM parents WHERE parent IS NOT NULL AND parent <> child UNION ALL SELECT up.child, p.parent, up.depth + 1 FROM up JOIN parents p ON p.child = up.ancestor WHERE p.parent IS NOT NULL AND p.parent <> p.child AND up.depth < 32) SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM up GROUP BY child, ancestor")
def closure(spark, sf):
    k = F.col("p_partkey")
    return C.ancestors(table(spark, sf, "part").select(k.alias("child"), F.when(k > 0, F.floor(k / 10)).alias("parent")))


@query("WITH v AS (SELECT p_brand AS policy, p_type AS model, p_partkey AS o FROM part), c AS (SELECT policy, model, count(*) AS votes, min(o) AS f FROM v GROUP BY ALL) SELECT policy, model, votes FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY votes DESC, f) AS n FROM c) WHERE n = 1")
def policy_vote(spark, sf):
    return C.vote(table(spark, sf, "part").select(F.col("p_brand").alias("policy"), F.col("p_type").alias("model"), F.col("p_partkey").alias("o")), "policy", "model", "o")


@query("SELECT short, fqcn FROM (SELECT p_name || p_size AS short, min('App\\' || p_brand || '\\' || p_name || p_size) AS fqcn, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name || p_size) WHERE n = 1")
def unique_short_names(spark, sf):
    c = table(spark, sf, "part").select(F.concat_ws("\\", F.lit("App"), "p_brand", F.concat("p_name", F.col("p_size").cast("string"))).alias("fqcn"))
    return C.unique_names(c)


VERBS = ["GET", "POST", "PUT", "HEAD", "DELETE"]
R_ = f"r AS (SELECT p_partkey AS ordinal, {sql_pick(VERBS, 'p_partkey % 5')} AS verb, '/' || p_type || '/' || (p_size % 10) AS uri, 'App\\Http\\' || replace(p_name, ' ', '') || 'Controller@m' || (p_size % 8) AS action FROM part)"


def routes(spark, sf):
    p = table(spark, sf, "part")
    action = F.concat(F.lit("App\\Http\\"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("Controller@m"), (F.col("p_size") % 8).cast("string"))
    return p.select(F.col("p_partkey").alias("ordinal"), pick(VERBS, F.col("p_partkey") % 5).alias("verb"), F.concat(F.lit("/"), "p_type", F.lit("/"), (F.col("p_size") % 10).cast("string")).alias("uri"), action.alias("action"), F.array(F.lit("web")).alias("middleware"))


@query(f"WITH {R_} SELECT action, uri, string_agg(DISTINCT verb, '|' ORDER BY verb) AS verbs FROM r WHERE verb <> 'HEAD' GROUP BY action, uri")
def verb_merge(spark, sf):
    return C.merge_verbs(routes(spark, sf))


A_ = "a AS (SELECT DISTINCT 'Other\\' || replace(p_name, ' ', '') || 'Controller' AS class, 'M' || (p_partkey % 12) AS method FROM part)"


def actions(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("Other\\"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("Controller")).alias("class"), F.concat(F.lit("M"), (F.col("p_partkey") % 12).cast("string")).alias("method")).distinct()


KEYS = "lower(regexp_replace(split_part(action, '@', 1), '^.*\\\\', '')) AS c, lower(split_part(action, '@', 2)) AS m"


@query(f"WITH {R_}, {A_}, k AS (SELECT DISTINCT {KEYS} FROM r) SELECT class, method FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.c = lower(regexp_replace(a.class, '^.*\\\\', '')) AND k.m = lower(a.method))")
def unrouted_actions(spark, sf):
    return C.unrouted(actions(spark, sf), routes(spark, sf))


@query(f"WITH {R_}, {A_}, k AS (SELECT {KEYS}, verb, uri, row_number() OVER (PARTITION BY c, m ORDER BY ordinal) AS n FROM (SELECT *, {KEYS} FROM r)) SELECT class, method, verb, uri FROM a LEFT JOIN (SELECT * FROM k WHERE n = 1) k ON k.c = lower(regexp_replace(a.class, '^.*\\\\', '')) AND k.m = lower(a.method)".replace(f"SELECT {KEYS}, verb", "SELECT c, m, verb"))
def route_first_match(spark, sf):
    return C.first_route(actions(spark, sf), routes(spark, sf)).select("class", "method", "verb", "uri")


@query(f"""WITH u AS (SELECT DISTINCT '/' || lower(p_type) || 's' AS uri, p_size % 2 = 0 AS api, CASE WHEN p_size % 3 = 0 THEN ['index', 'show'] END AS only_, CASE WHEN p_size % 3 = 1 THEN ['destroy', 'create'] END AS except_ FROM part), t(method, verb, tail) AS (VALUES {sql_values(RESOURCE_ROUTES)})
SELECT uri, method, verb, uri || replace(tail, '{{p}}', '{{' || regexp_replace(regexp_replace(uri, '^/', ''), 's$', '') || '}}') AS full_uri FROM u CROSS JOIN t WHERE (NOT api OR method NOT IN ('create', 'edit')) AND (only_ IS NULL OR list_contains(only_, method)) AND (except_ IS NULL OR NOT list_contains(except_, method))""")
def resource_routes(spark, sf):
    s = F.col("p_size")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    res = table(spark, sf, "part").select(F.concat(F.lit("/"), F.lower("p_type"), F.lit("s")).alias("uri"), (s % 2 == 0).alias("api"), F.when(s % 3 == 0, words("index", "show")).alias("only"), F.when(s % 3 == 1, words("destroy", "create")).alias("except")).distinct()
    return C.expand_resources(res)


@query("""WITH g AS (SELECT p_partkey % 40 AS file, p_size * 10 AS s, p_size * 10 + 200 AS e, min(p_brand) AS mw FROM part GROUP BY ALL), r AS (SELECT DISTINCT p_partkey % 40 AS file, p_size * 10 + 5 AS position FROM part),
j AS (SELECT r.file, r.position, mw, min(s) AS s FROM r LEFT JOIN g ON g.file = r.file AND position > s AND position < e GROUP BY ALL) SELECT file, position, coalesce(string_agg(mw, ',' ORDER BY s, mw), '') AS middleware FROM j GROUP BY ALL""")
def group_middleware(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("file"), "p_partkey", "p_size", "p_brand")
    groups = p.groupBy("file", (F.col("p_size") * 10).alias("start")).agg(F.array(F.min("p_brand")).alias("middleware")).withColumn("end", F.col("start") + 200)
    at = p.select("file", (F.col("p_size") * 10 + 5).alias("position")).distinct()
    return C.inherited_middleware(at, groups).select("file", "position", F.array_join("middleware", ",").alias("middleware"))


@query("""WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'repo/app/' ELSE 'app/' END || p_brand || '/F' || (p_size % 20) || '.php' AS location FROM part), c AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'app/' ELSE '' END || p_brand || '/F' || (p_size % 15) || '.php' AS path FROM part)
SELECT id, location, path FROM (SELECT f.id, f.location, c.path, row_number() OVER (PARTITION BY id ORDER BY length(c.path) DESC, c.path) AS n FROM f LEFT JOIN c ON f.location = c.path OR suffix(f.location, '/' || c.path) OR suffix(c.path, '/' || f.location)) WHERE n = 1""")
def suffix_longest(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    f = p.select(k.alias("id"), F.concat(F.when(k % 3 == 0, "repo/app/").otherwise("app/"), "p_brand", F.lit("/F"), (F.col("p_size") % 20).cast("string"), F.lit(".php")).alias("location"))
    c = p.select(F.concat(F.when(k % 2 == 0, "app/").otherwise(""), "p_brand", F.lit("/F"), (F.col("p_size") % 15).cast("string"), F.lit(".php")).alias("path"))
    return C.locate(f, c)


@query("SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id = a.doc_id AND md5(b.text) = md5(CASE WHEN a.n_chars % 6 = 0 THEN a.text || 'x' ELSE a.text END) AND b.lang <> 'fr')")
def changed_files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    head = d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("n_chars") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    base = d.where("lang <> 'fr'").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return C.changed(head, base).select(F.col("path").cast("long").alias("doc_id"))


@query("SELECT l_orderkey AS k, CASE max(CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber < 4 THEN 3 ELSE 2 END WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) WHEN 3 THEN 'tainted' WHEN 2 THEN 'tainted_path' WHEN 1 THEN 'unknown' ELSE 'trusted' END AS judgement FROM lineitem GROUP BY l_orderkey")
def taint_combine(spark, sf):
    flag = F.col("l_returnflag")
    j = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(flag == "A", "tainted").when(flag == "N", "trusted").otherwise("unknown").alias("trust"), F.when(F.col("l_linenumber") < 4, "full").otherwise("path").alias("reach"))
    return C.combine_taint(j, ("k",))


@query("""WITH p AS (SELECT p_partkey, [p_brand, p_type, 'x'] AS a, [p_type, 'y'] AS b, p_size % 3 AS k FROM part) SELECT p_partkey, 'only' AS only_kind, array_to_string(list_sort(list_filter(b, lambda x: k = 0 OR (k = 1 AND list_contains(a, x)) OR (k = 2 AND NOT list_contains(a, x)))), ',') AS only_fields,
  CASE WHEN k = 1 THEN 'only' ELSE 'except' END AS except_kind, array_to_string(list_sort(CASE WHEN k = 1 THEN list_filter(a, lambda x: NOT list_contains(b, x)) WHEN k = 2 THEN list_distinct(list_concat(a, b)) ELSE b END), ',') AS except_fields, k = 0 OR (k = 1 AND list_contains(a, 'x')) OR (k = 2 AND NOT list_contains(a, 'x')) AS reaches_x FROM p""")
def reach_algebra(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "all").when(F.col("p_size") % 3 == 1, "only").otherwise("except")
    a = F.when(F.col("p_size") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("p_brand", "p_type", F.lit("x")))
    p = table(spark, sf, "part").select("p_partkey", F.struct(kind.alias("kind"), a.alias("fields")).alias("r"), F.array("p_type", F.lit("y")).alias("b"))
    only, rest = C.reach_only(F.col("r"), F.col("b")), C.reach_except(F.col("r"), F.col("b"))
    joined = lambda x: F.array_join(F.array_sort(x["fields"]), ",")
    return p.select("p_partkey", only["kind"].alias("only_kind"), joined(only).alias("only_fields"), rest["kind"].alias("except_kind"), joined(rest).alias("except_fields"), C.reaches(F.col("r"), F.lit("x")).alias("reaches_x"))


@query(f"WITH {FINDINGS} SELECT n_name AS category, r_name AS area, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM f JOIN nation ON n_nationkey = f.supp % 25 JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def category_rollup(spark, sf):
    from codequarry.functions import text as T

    f = findings(spark, sf).join(F.broadcast(table(spark, sf, "nation")), F.col("supp") % 25 == F.col("n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return f.groupBy(F.col("n_name").alias("category"), F.col("r_name").alias("area")).agg(F.count("*").alias("n"), F.sum(T.weight_of(F.col("severity"))).alias("weight"))


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, ['$hidden', '#[Hidden]', '$guarded', '#[Guarded]'][CAST(p_partkey % 4 AS INT) + 1] AS site, CAST(p_partkey % 4 AS INT) AS n,
  lower(p_brand) AS a, lower(p_type) AS b FROM part),
up(model, id, depth) AS (SELECT id, id, 0 FROM c UNION ALL SELECT up.model, c.parent, up.depth + 1 FROM up JOIN c ON c.id = up.id WHERE c.parent IS NOT NULL),
m AS (SELECT up.model, c.site, c.n, min(depth) AS depth FROM up JOIN c x ON x.id = up.model JOIN c ON c.id = up.id AND x.a IN (c.a, c.b) GROUP BY ALL)
SELECT c.id AS model, coalesce(string_agg(m.site, ',' ORDER BY m.depth, m.n), '') AS sites FROM c LEFT JOIN m ON m.model = c.id GROUP BY c.id""")
def redaction_sites(spark, sf):
    """Each class asks for its own brand, in another case, along a tree of classes."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("class"), "p_partkey", "p_brand", "p_type")
    n = F.col("p_partkey") % 4
    heading, form = F.when(n < 2, "hidden").otherwise("guarded"), F.when(n % 2 == 0, "property").otherwise("attribute")
    declared = p.select("class", heading.alias("heading"), form.alias("form"), F.array("p_brand", "p_type").alias("names"))
    parents = p.where("p_partkey > 1").select(F.col("class").alias("child"), F.floor(F.col("p_partkey") / 2).cast("string").alias("parent"))
    found = C.redactions(p.select(F.col("class").alias("model"), F.upper("p_brand").alias("attribute")), declared, parents)
    return found.select(F.col("model").cast("long").alias("model"), F.array_join("sites", ",").alias("sites"))
