"""Queries over policies, kinds, locations, models and phrases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import rules
from codequarry.functions import text as T
from codequarry.operators import catalogue as C
from codequarry.operators import findings as O
from codequarry.plans.surrogates import FINDINGS, findings, pick, sql_pick, table
from codequarry.registry import sql_values

QUERIES, ORACLE_SQL = {}, {}
W = f"WITH {FINDINGS} "


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'app/' || p_brand || '/F' || (p_size % 20) || '.php' WHEN 1 THEN p_brand || '/F' || (p_size % 20) || '.php' ELSE 'F' || p_size || '.blade' END AS location FROM part),
c AS (SELECT DISTINCT 'app/' || p_brand || '/F' || (p_size % 17) || '.php' AS path FROM part UNION SELECT 'lib/F' || p_size || '.php' FROM part WHERE p_size > 40),
s AS (SELECT id, 1 AS step, path FROM f JOIN c ON location = path UNION ALL SELECT id, 2, path FROM f JOIN c ON (suffix(path, '/' || location) OR suffix(location, '/' || path)) UNION ALL
  SELECT id, 3, path FROM f JOIN c ON regexp_replace(regexp_replace(location, '^.*/', ''), '\\.[^.]*$', '') = regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')),
o AS (SELECT id, step, min(path) AS path FROM s GROUP BY id, step HAVING count(*) = 1) SELECT f.id, f.location, b.path FROM f LEFT JOIN (SELECT id, arg_min(path, step) AS path FROM o GROUP BY id) b ON f.id = b.id""")
def location_priority(spark, sf):
    p = table(spark, sf, "part")
    n = lambda c: (F.col("p_size") % c).cast("string")
    loc = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("app/"), "p_brand", F.lit("/F"), n(20), F.lit(".php"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit("/F"), n(20), F.lit(".php"))).otherwise(F.concat(F.lit("F"), F.col("p_size").cast("string"), F.lit(".blade")))
    files = p.select(F.concat(F.lit("app/"), "p_brand", F.lit("/F"), n(17), F.lit(".php")).alias("path")).union(p.where("p_size > 40").select(F.concat(F.lit("lib/F"), F.col("p_size").cast("string"), F.lit(".php"))))
    return C.resolve_location(p.select(F.col("p_partkey").alias("id"), loc.alias("location")), files)


@query("""WITH p AS (SELECT DISTINCT 'App\\' || p_type || 'Policy' AS policy FROM part UNION SELECT DISTINCT 'App\\' || replace(p_name, ' ', '') || p_size || 'Policy' FROM part), e AS (SELECT 'App\\SMALLPolicy' AS policy, 'App\\Models\\Explicit' AS model),
m AS (SELECT DISTINCT 'App\\Models\\' || p_type AS model FROM part WHERE p_type <> 'LARGE'), i AS (SELECT DISTINCT 'App\\' || replace(p_name, ' ', '') || p_size || 'Policy' AS policy, 'App\\Models\\' || p_type AS model FROM part),
u AS (SELECT policy, min(i.model) AS model FROM i JOIN m ON i.model = m.model GROUP BY policy HAVING count(DISTINCT i.model) = 1)
SELECT p.policy, coalesce(e.model, m.model, u.model) AS model FROM p LEFT JOIN e ON p.policy = e.policy LEFT JOIN m ON m.model = 'App\\Models\\' || regexp_replace(regexp_replace(p.policy, '^.*\\\\', ''), 'Policy$', '') LEFT JOIN u ON u.policy = p.policy""")
def policy_chain(spark, sf):
    p = table(spark, sf, "part")
    by_brand = F.concat(F.lit("App\\"), F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size").cast("string"), F.lit("Policy"))
    policies = p.select(F.concat(F.lit("App\\"), "p_type", F.lit("Policy")).alias("policy")).union(p.select(by_brand)).distinct()
    model = F.concat(F.lit("App\\Models\\"), "p_type").alias("model")
    explicit = spark.createDataFrame([("App\\SMALLPolicy", "App\\Models\\Explicit")], "policy string, model string")
    return C.policy_models(policies, explicit, p.where("p_type <> 'LARGE'").select(model).distinct(), p.select(by_brand.alias("policy"), model).distinct())


METHODS = ["view", "Update", "before", "__construct", "delete", "helper", "deny"]
MT = f"m AS (SELECT p_brand || (p_size % 9) AS class, {sql_pick(METHODS, 'p_partkey % 7')} AS method, CASE WHEN p_size % 5 = 0 THEN 'protected' ELSE 'public' END AS visibility FROM part)"


def methods(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat("p_brand", (F.col("p_size") % 9).cast("string")).alias("class"), pick(METHODS, F.col("p_partkey") % 7).alias("method"), F.when(F.col("p_size") % 5 == 0, "protected").otherwise("public").alias("visibility"))


@query(f"WITH {MT} SELECT class, string_agg(DISTINCT method, ',' ORDER BY method) AS abilities FROM m WHERE visibility = 'public' AND lower(method) NOT IN ('__construct', 'before', 'after', 'allow', 'deny', 'denywithstatus', 'denyasnotfound') GROUP BY class")
def policy_abilities(spark, sf):
    return C.abilities(methods(spark, sf)).withColumn("abilities", F.array_join("abilities", ","))


@query(f"WITH {MT}, d AS (SELECT DISTINCT lower(class) AS c, lower(method) AS a FROM m WHERE visibility = 'public' AND lower(method) NOT IN ('__construct', 'before', 'after', 'allow', 'deny', 'denywithstatus', 'denyasnotfound')), q AS (SELECT DISTINCT 'App\\' || upper(p_brand) || (p_size % 9) AS model, CASE WHEN p_size % 2 = 0 THEN 'UPDATE' ELSE 'view' END AS ability FROM part) SELECT model, ability, EXISTS (SELECT 1 FROM d WHERE d.c = lower(regexp_replace(model, '^.*\\\\', '')) AND d.a = lower(ability)) AS declared FROM q")
def ability_lookup(spark, sf):
    asked = table(spark, sf, "part").select(F.concat(F.lit("App\\"), F.upper("p_brand"), (F.col("p_size") % 9).cast("string")).alias("model"), F.when(F.col("p_size") % 2 == 0, "UPDATE").otherwise("view").alias("ability")).distinct()
    return C.has_ability(asked, C.abilities(methods(spark, sf)).withColumnRenamed("class", "model"))


UP = "parents AS (SELECT p_partkey AS child, CASE WHEN p_partkey > 0 THEN p_partkey // 10 END AS parent FROM part), up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM parents WHERE parent IS NOT NULL AND parent <> child UNION ALL SELECT up.child, p.parent, up.depth + 1 FROM up JOIN parents p ON p.child = up.ancestor WHERE p.parent IS NOT NULL AND p.parent <> p.child AND up.depth < 32)"


def closure(spark, sf):
    k = F.col("p_partkey")
    return C.ancestors(table(spark, sf, "part").select(k.alias("child"), F.when(k > 0, F.floor(k / 10)).alias("parent")))


@query(f"WITH RECURSIVE {UP} SELECT DISTINCT child FROM up WHERE ancestor IN (7, 12)")
def descendants(spark, sf):
    up = closure(spark, sf).select("child", F.col("ancestor").cast("string").alias("ancestor"))
    return C.descends(up, ["7", "12"])


@query(f"WITH RECURSIVE {UP}, k AS (SELECT p_partkey AS class, p_size FROM part WHERE p_partkey % 13 <> 5), fam AS (SELECT class AS child, class AS ancestor FROM k UNION ALL SELECT child, ancestor FROM up), h AS (SELECT p_partkey FROM part WHERE p_size = 1) SELECT child AS class, CASE WHEN bool_or(ancestor IN (SELECT p_partkey FROM h)) THEN 'callable' WHEN bool_and(ancestor IN (SELECT class FROM k)) THEN 'absent' ELSE 'unknown' END AS availability FROM fam GROUP BY child")
def authorize_availability(spark, sf):
    p = table(spark, sf, "part")
    return C.authorize_available(p.where("p_partkey % 13 <> 5").select(F.col("p_partkey").alias("class")), closure(spark, sf), p.where("p_size = 1").select(F.col("p_partkey").alias("class")))


CLASSES = ["Illuminate\\Support\\Facades\\Http", "App\\Models\\Model", "Storage", "App\\BillingService", "Illuminate\\Support\\Collection", "FormRequest", "Weird"]
CALLED = ["get", "where", "pluck", "withToken", "disk", "validated", "other"]
_KIND = " ".join(f"WHEN regexp_replace(c, '^.*\\\\', '') IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names, _ in C.RECEIVERS) + " WHEN suffix(c, 'Service') THEN 'local_service' " + " ".join(f"WHEN c IS NULL AND lower(m) IN ({', '.join(repr(n) for n in ms)}) THEN '{kind}'" for kind, _, ms in C.RECEIVERS)


@query(f"SELECT c AS class, m AS method, CASE {_KIND} ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN NULL ELSE {sql_pick(CLASSES, 'p_partkey % 7')} END AS c, {sql_pick(CALLED, 'p_size % 7')} AS m FROM part) GROUP BY ALL")
def receiver_kinds(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") % 3 != 0, pick(CLASSES, F.col("p_partkey") % 7)).alias("class"), pick(CALLED, F.col("p_size") % 7).alias("method"))
    return p.groupBy("class", "method", C.receiver_kind(F.col("class"), F.col("method")).alias("kind")).agg(F.count("*").alias("n"))


TIERS = [("a", "m1", "balanced", None, 0), ("a", "m2-old", "flagship", "m2", 1), ("a", "m2", "flagship", None, 2), ("b", "n1", "fast", None, 3), ("b", "n2", "balanced", None, 4), ("c", "o1", "flagship", None, 5)]


@query(f"SELECT provider, model FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY CASE WHEN tier = 'flagship' AND alias_of IS NULL THEN 0 WHEN alias_of IS NULL THEN 1 ELSE 2 END, o) AS n FROM (VALUES {sql_values(TIERS)}) t(provider, model, tier, alias_of, o)) WHERE n = 1")
def preferred_models(spark, sf):
    return C.preferred_model(spark.createDataFrame(TIERS, "provider string, model string, tier string, alias_of string, ordinal int"), "flagship")


@query(W + "SELECT scan_id, part, supp, line, price FROM f WHERE class = 'vulnerability' AND severity IN ('critical', 'high') AND part % 50 < 20")
def verifiable_findings(spark, sf):
    files = table(spark, sf, "part").where("p_partkey % 50 < 20").select(F.concat(F.lit("./app/F"), (F.col("p_partkey") % 50).cast("string"), F.lit(".php")).alias("path"))
    return O.verifiable(findings(spark, sf), files).select("scan_id", "part", "supp", "line", "price")


@query(W + "SELECT type, CASE WHEN part % 3 = 0 THEN 'review' ELSE class END AS class, count(*) AS n, count(*) FILTER (class = 'vulnerability' AND part % 3 <> 0 AND confidence = 'proven') AS fixable, count(*) FILTER (confidence IN ('proven', 'probable')) AS likely FROM f GROUP BY ALL")
def reclassified(spark, sf):
    f = O.reclassify(findings(spark, sf), F.when(F.col("part") % 3 == 0, "review").otherwise(F.col("class")), F.col("confidence"))
    return f.groupBy("type", "class").agg(F.count("*").alias("n"), F.count_if(O.may_fix()).alias("fixable"), F.count_if(O.at_least(F.col("confidence"), "probable")).alias("likely"))


@query(W + "SELECT DISTINCT class, CASE WHEN class = 'vulnerability' THEN description ELSE 'Is this intended: ' || description || '?' END AS phrase FROM f")
def review_questions(spark, sf):
    return O.question(findings(spark, sf)).select("class", "phrase").distinct()


@query(W + "SELECT scan_id, location, line, type, part FROM (SELECT *, row_number() OVER (PARTITION BY target, location ORDER BY CASE class WHEN 'vulnerability' THEN 0 ELSE 1 END, line, part, scan_id, supp, price) AS n FROM f) WHERE n = 1")
def first_exposure(spark, sf):
    n = F.row_number().over(Window.partitionBy("target", "location").orderBy(F.when(O.confirmed(), 0).otherwise(1), "line", "part", "scan_id", "supp", "price"))
    return findings(spark, sf).withColumn("n", n).where("n = 1").select("scan_id", "location", "line", "type", "part")


LIMITS = ["return Limit::perMinute(60);", "Limit :: perHour( 5 )->by($r->ip())", "return Limit::none();", "return custom();"]


@query(f"SELECT body, CASE WHEN regexp_matches(body, 'Limit\\s*::\\s*per(Minute|Hour|Day)') THEN regexp_extract(body, '\\(\\s*(\\d+)\\s*\\)', 1) || ' per ' || lower(regexp_extract(body, 'per(Minute|Hour|Day)', 1)) WHEN contains(body, 'Limit::none()') THEN 'unlimited' ELSE 'custom rate limit' END AS summary, count(*) AS n FROM (SELECT {sql_pick(LIMITS, 'p_partkey % 4')} AS body FROM part) GROUP BY ALL")
def rate_limiters(spark, sf):
    return table(spark, sf, "part").select(pick(LIMITS, F.col("p_partkey") % 4).alias("body")).groupBy("body", rules.rate_limit_summary(F.col("body")).alias("summary")).agg(F.count("*").alias("n"))


HANDLERS = ["abort(403);", "RateLimiter::hit();", "if (Auth::check()) {}", "return redirect('/');", "$request->header('x');", "decrypt($x);", "Log::info('a');", "$next($request);"]


@query(f"SELECT b, CASE WHEN contains(b, 'abort(403') THEN 'Authorization check middleware' WHEN contains(b, 'RateLimiter') THEN 'Rate limiting middleware' WHEN contains(b, 'Auth::check') THEN 'Authentication check middleware' WHEN contains(b, 'redirect(') THEN 'Redirect middleware' WHEN contains(b, '$request->header') THEN 'Header validation middleware' WHEN contains(b, 'decrypt') THEN 'Encryption middleware' WHEN contains(b, 'Log::') THEN 'Logging middleware' ELSE b END AS summary, count(*) AS n FROM (SELECT {sql_pick(HANDLERS, 'p_partkey % 8')} AS b FROM part) GROUP BY ALL")
def middleware_handlers(spark, sf):
    code = F.concat(F.lit("function handle($request, $next) {\n    "), F.col("b"), F.lit("\n}\n"))
    return table(spark, sf, "part").select(pick(HANDLERS, F.col("p_partkey") % 8).alias("b")).groupBy("b", rules.middleware_summary(code).alias("summary")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, '/' || concat_ws('/', CASE WHEN p_size % 3 > 0 THEN 'v1' END, lower(p_type), CASE WHEN p_size % 2 > 0 THEN 'x' || p_size END) AS uri FROM part")
def prefixes(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", T.join_prefix(F.when(s % 3 > 0, "/v1/").otherwise(""), F.concat(F.lower("p_type"), F.lit("/")), F.when(s % 2 > 0, F.concat(F.lit("/x"), s.cast("string"))).otherwise("/")).alias("uri"))


@query("SELECT p_partkey, string_agg(upper(w[1]) || lower(w[2:]), '' ORDER BY i) AS studly FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part) GROUP BY p_partkey")
def studly_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.studly(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("studly"))


@query("SELECT severity, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, confidence, CASE confidence WHEN 'proven' THEN 'very-high' WHEN 'probable' THEN 'high' ELSE 'medium' END AS precision, count(*) AS n FROM f GROUP BY ALL".join([W, ""]))
def interchange_levels(spark, sf):
    s, c = F.col("severity"), F.col("confidence")
    return findings(spark, sf).groupBy("severity", T.level_of(s).alias("level"), "confidence", T.precision_of(c).alias("precision")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT c_nationkey AS scan, 's' || c_mktsegment AS name, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS priority, CAST(count(*) * 10 AS BIGINT) AS tokens FROM customer GROUP BY c_nationkey, c_mktsegment), a AS (SELECT *, sum(tokens) OVER (PARTITION BY scan ORDER BY priority) AS total FROM p) SELECT scan, string_agg('## ' || name || chr(10) || 'text', chr(10) || chr(10) ORDER BY priority) AS context, CAST(sum(tokens) AS BIGINT) AS tokens FROM a GROUP BY scan")
def context_sections(spark, sf):
    p = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("scan"), "c_mktsegment").agg((F.count("*") * 10).alias("tokens"))
    p = p.select("scan", F.concat(F.lit("s"), "c_mktsegment").alias("name"), F.dense_rank().over(Window.partitionBy("scan").orderBy("c_mktsegment")).alias("priority"), "tokens", F.lit("text").alias("text"))
    return C.sections(p, 10**9)


@query("SELECT l_orderkey AS scan_id, CAST(sum(l_linenumber) AS BIGINT) AS scan_tokens, CAST(coalesce(sum(l_partkey) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS verification_tokens FROM lineitem GROUP BY l_orderkey")
def usage_buckets(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.sum("l_linenumber").alias("scan_tokens"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))), F.lit(0)).alias("verification_tokens"))
