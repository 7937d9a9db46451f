"""Queries over findings: scores, identity, dedupe, comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry import registry as R
from codequarry.functions import text as T
from codequarry.operators import findings as O
from codequarry.operators import scans
from codequarry.plans.surrogates import FINDINGS, ORDER, TOKEN, findings

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


W = f"WITH {FINDINGS} "
SEV = "CASE weight WHEN 40 THEN 'critical' WHEN 20 THEN 'high' WHEN 10 THEN 'medium' ELSE 'low' END"


@query(W + "SELECT scan_id, CAST(greatest(0, 100 - sum(CASE WHEN class = 'vulnerability' THEN weight ELSE 0 END)) AS INT) AS score, count(*) FILTER (class = 'vulnerability') AS n_confirmed, count(*) FILTER (class <> 'vulnerability') AS n_review FROM f GROUP BY scan_id")
def severity_score(spark, sf):
    return O.scores(findings(spark, sf))


@query(W + f"SELECT s.status, d.severity, coalesce(n, 0) AS n, CAST(d.weight AS INT) AS weight, CAST(coalesce(n, 0) * d.weight AS BIGINT) AS penalty FROM (SELECT DISTINCT status FROM f) s CROSS JOIN (VALUES {R.sql_values((s, w) for s, w, *_ in R.SEVERITIES)}) d(severity, weight) LEFT JOIN (SELECT status, severity, count(*) AS n FROM f WHERE class = 'vulnerability' GROUP BY ALL) c ON c.status = s.status AND c.severity = d.severity")
def score_breakdown(spark, sf):
    f = findings(spark, sf)
    return O.score_breakdown(f, f.select("status"), "status")


@query(W + "SELECT type, count(*) FILTER (class = 'vulnerability' AND severity = 'critical') AS critical, count(*) FILTER (class = 'vulnerability' AND severity = 'high') AS high, count(*) FILTER (class = 'vulnerability' AND severity = 'medium') AS medium, count(*) FILTER (class = 'vulnerability' AND severity = 'low') AS low, count(*) FILTER (class = 'vulnerability') AS total, count(*) FILTER (class = 'review') AS review FROM f GROUP BY type")
def severity_counts(spark, sf):
    ok = O.confirmed()
    return findings(spark, sf).groupBy("type").agg(*[F.count_if(ok & (F.col("severity") == s)).alias(s) for s, *_ in R.SEVERITIES], F.count_if(ok).alias("total"), F.count_if(~ok).alias("review"))


@query(W + "SELECT scan_id, coalesce(bool_or(class = 'vulnerability' AND weight >= 20), false) AS fails FROM f GROUP BY scan_id")
def exit_gate(spark, sf):
    return O.fails_gate(findings(spark, sf), "high")


@query(W + "SELECT class, confidence, count(*) AS n, count(*) FILTER (fix = '') AS n_without_fix FROM f GROUP BY ALL")
def class_invariant(spark, sf):
    return findings(spark, sf).groupBy("class", "confidence").agg(F.count("*").alias("n"), F.count_if(F.col("fix") == "").alias("n_without_fix"))


PRINTS = f"""p AS (SELECT *, substr(sha256('{R.EngineConfig.fingerprint_prefix}' || k || '|' || occurrence), 1, 32) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY status, k ORDER BY scan_id, line, part, supp, price) - 1 AS occurrence
  FROM (SELECT *, type || '|' || location || '|line:' || line AS k FROM f)))"""


def printed(spark, sf):
    return O.fingerprint(findings(spark, sf), ("status",), ORDER)


@query(W + ", " + PRINTS + " SELECT scan_id, part, supp, line, CAST(occurrence AS INT) AS occurrence, fingerprint FROM p")
def fingerprint(spark, sf):
    return printed(spark, sf).select("scan_id", "part", "supp", "line", "occurrence", "fingerprint")


@query(W + ", " + PRINTS + """ SELECT type, count(*) AS n FROM p WHERE status = 'O' AND fingerprint NOT IN (SELECT fingerprint FROM p WHERE status = 'F' AND shipped < TIMESTAMP '1998-06-01')
  AND (location, type, md5(description)) NOT IN (SELECT (location, type, md5(description)) FROM p WHERE status = 'F' AND shipped >= TIMESTAMP '2002-01-01') GROUP BY type""")
def baseline_filter(spark, sf):
    p = printed(spark, sf)
    old = p.where("status = 'F'")
    coded = old.where("shipped < timestamp_ntz'1998-06-01 00:00:00'").select("fingerprint", F.col("location").alias("file"), "type", F.lit(None).cast("string").alias("hash"))
    legacy = old.where("shipped >= timestamp_ntz'2002-01-01 00:00:00'").select(F.lit(None).cast("string").alias("fingerprint"), F.col("location").alias("file"), "type", F.md5(F.col("description").cast("binary")).alias("hash"))
    return O.without_baseline(p.where("status = 'O'"), coded.unionByName(legacy)).groupBy("type").agg(F.count("*").alias("n"))


@query(W + ", " + PRINTS + ", a AS (SELECT DISTINCT fingerprint FROM p WHERE status = 'O'), b AS (SELECT DISTINCT fingerprint FROM p WHERE status = 'F') SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN a.fingerprint IS NULL THEN 'resolved' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.fingerprint = b.fingerprint")
def scan_compare(spark, sf):
    p = printed(spark, sf)
    return O.compare(p.where("status = 'O'"), p.where("status = 'F'"))


@query(W + ", " + PRINTS + " SELECT DISTINCT fingerprint FROM p WHERE status = 'F' EXCEPT SELECT fingerprint FROM p WHERE status = 'O'")
def resolved(spark, sf):
    p = printed(spark, sf)
    return p.where("status = 'F'").select("fingerprint").subtract(p.where("status = 'O'").select("fingerprint"))


@query(W + ", s AS (SELECT target, scan_id, CAST(greatest(0, 100 - sum(CASE WHEN class = 'vulnerability' THEN weight ELSE 0 END)) AS INT) AS score FROM f GROUP BY ALL) SELECT target, scan_id, score, score - lag(score) OVER (PARTITION BY target ORDER BY scan_id) AS delta FROM s")
def score_delta(spark, sf):
    s = O.scores(findings(spark, sf), ("target", "scan_id")).select("target", "scan_id", "score")
    return scans.score_delta(s, ("target",), "scan_id")


@query(W + f"SELECT scan_id, type, location, line, part, supp FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, {TOKEN}, location, line ORDER BY part, supp, price) AS n FROM f) WHERE n = 1")
def exact_dedupe(spark, sf):
    return O.drop_exact(findings(spark, sf), ("scan_id",), ("part", "supp", "price")).select("scan_id", "type", "location", "line", "part", "supp")


@query(W + f"SELECT scan_id, type, location, line, part, supp FROM f a WHERE confidence = 'proven' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.confidence <> 'proven' AND b.scan_id % 200 = a.scan_id % 200 AND b.location = a.location AND {TOKEN.replace('type', 'b.type')} = {TOKEN.replace('type', 'a.type')} AND abs(a.line - b.line) <= 5)")
def cross_source_antijoin(spark, sf):
    f = findings(spark, sf).withColumn("grp", F.col("scan_id") % 200)
    return O.not_near(f.where("confidence = 'proven'"), f.where("confidence <> 'proven'"), ("grp", "location")).select("scan_id", "type", "location", "line", "part", "supp")


@query(W + "SELECT scan_id, location, line, part, supp FROM f a WHERE type = 'idor' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.type = 'auth_bypass' AND b.location = a.location AND b.scan_id % 100 = a.scan_id % 100 AND a.line BETWEEN b.line AND b.line + 2)")
def span_collapse(spark, sf):
    f = findings(spark, sf).withColumn("grp", F.col("scan_id") % 100)
    spans = f.where("type = 'auth_bypass'").select("grp", "location", F.col("line").alias("start"), (F.col("line") + 2).alias("end"))
    return O.outside_spans(f.where("type = 'idor'"), spans, ("grp", "location")).select("scan_id", "location", "line", "part", "supp")


@query(W + "SELECT status, type, CAST(max(weight) FILTER (class = 'vulnerability') AS INT) AS worst, min(scan_id) AS first_scan, count(*) AS results FROM f GROUP BY ALL")
def sarif_rules(spark, sf):
    return findings(spark, sf).groupBy("status", "type").agg(F.max(F.when(O.confirmed(), T.weight_of(F.col("severity")))).alias("worst"), F.min("scan_id").alias("first_scan"), F.count("*").alias("results"))


@query(W + "SELECT type, count(DISTINCT location) AS files FROM f GROUP BY type")
def affected_files(spark, sf):
    return findings(spark, sf).groupBy("type").agg(F.countDistinct("location").alias("files"))


@query(W + "SELECT scan_id, type, line, part, supp FROM f WHERE class = 'vulnerability' AND weight >= 20")
def minimum_severity(spark, sf):
    return findings(spark, sf).where(O.confirmed() & (T.weight_of(F.col("severity")) >= 20)).select("scan_id", "type", "line", "part", "supp")


@query(W + f", t(type, type_label, owasp, cwe) AS (VALUES {R.sql_values(R.TYPES)}) SELECT t.owasp, t.cwe, severity, {SEV.replace('critical', '9.5').replace('high', '8.0').replace('medium', '5.5').replace('low', '3.0')} AS security_severity, count(*) AS n FROM f JOIN t USING (type) GROUP BY ALL")
def type_attributes(spark, sf):
    return O.describe(findings(spark, sf)).groupBy("owasp", "cwe", "severity", "security_severity").agg(F.count("*").alias("n"))


@query(f"SELECT t.type, r.n AS n_references, r.first FROM (VALUES {R.sql_values(((t[0], t[3]) for t in R.TYPES))}) t(type, first) JOIN (SELECT type, first, count(*) AS n FROM (SELECT x.type, x.cwe AS first FROM (VALUES {R.sql_values(((t[0], t[3]) for t in R.TYPES))}) x(type, cwe) UNION ALL SELECT y.type, z.cwe FROM (VALUES {R.sql_values(((c[0],) for c in R.CHEAT_SHEETS))}) y(type) JOIN (VALUES {R.sql_values(((t[0], t[3]) for t in R.TYPES))}) z(type, cwe) ON y.type = z.type) GROUP BY ALL) r ON r.type = t.type")
def references(spark, sf):
    return O.references_table(spark).select("type", F.size("references").cast("long").alias("n_references"), F.col("references")[0]["title"].alias("first"))


@query(W + "SELECT scan_id, type, line, part, supp, price FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, scan_id, line, part, supp, price) AS n FROM f) WHERE n <= 3")
def worst_first(spark, sf):
    """Stable order by severity: the three worst findings of every target."""
    f = findings(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(T.weight_of(F.col("severity"))), *ORDER)))
    return f.where("n <= 3").select("scan_id", "type", "line", "part", "supp", "price")


@query(W + """SELECT type, CASE WHEN class = 'vulnerability' AND severity IN ('critical', 'high') AND part % 4 = 0 THEN CASE severity WHEN 'critical' THEN 'high' ELSE 'medium' END ELSE severity END AS severity,
  CASE WHEN class = 'vulnerability' AND severity IN ('critical', 'high') AND part % 4 = 0 THEN severity END AS original_severity, count(*) AS n FROM f GROUP BY ALL""")
def verify_downgrade(spark, sf):
    f = findings(spark, sf).withColumns({"ordinal": F.col("part"), "original_severity": F.lit(None).cast("string"), "exploit_verified": F.lit(None).cast("boolean"), "exploit_proof": F.lit(None).cast("string")})
    verified = F.when(F.col("part") % 4 == 0, False).when(F.col("part") % 4 == 2, True)
    out = O.verify(f, f.select(F.col("part").alias("ordinal"), verified.alias("verified"), F.lit("x").alias("exploit")).distinct())
    return out.groupBy("type", "severity", "original_severity").agg(F.count("*").alias("n"))


@query(W + f", u AS (SELECT *, {TOKEN} AS token FROM f) SELECT token, CAST(min(weight) AS INT) AS least, CAST(max(weight) AS INT) AS most, count(*) AS n FROM u GROUP BY token")
def access_tokens(spark, sf):
    w = T.weight_of(F.col("severity"))
    return findings(spark, sf).groupBy(O.token().alias("token")).agg(F.min(w).alias("least"), F.max(w).alias("most"), F.count("*").alias("n"))


@query(W + """, s AS (SELECT target, CAST(greatest(0, 100 - sum(CASE WHEN class = 'vulnerability' THEN weight ELSE 0 END)) AS INT) AS score, count(*) FILTER (class = 'vulnerability' AND severity = 'critical') AS critical FROM f GROUP BY target)
SELECT target, score, critical, CASE WHEN score >= 80 THEN 'brightgreen' WHEN score >= 60 THEN 'yellow' WHEN score >= 40 THEN 'orange' ELSE 'red' END AS badge,
  CASE WHEN critical >= 3 THEN '#ef4444' WHEN critical >= 1 AND score < 50 THEN '#ef4444' WHEN critical >= 1 AND score < 70 THEN '#f97316' WHEN score < 40 THEN '#ef4444' WHEN score < 60 THEN '#f97316' WHEN score < 80 THEN '#eab308' ELSE '#22c55e' END AS colour FROM s""")
def score_colours(spark, sf):
    w = F.when(O.confirmed(), T.weight_of(F.col("severity"))).otherwise(0)
    s = findings(spark, sf).groupBy("target").agg(F.greatest(F.lit(0), 100 - F.sum(w)).cast("int").alias("score"), F.count_if(O.confirmed() & (F.col("severity") == "critical")).alias("critical"))
    return s.withColumn("badge", T.badge_colour(F.col("score"))).withColumn("colour", T.score_colour(F.col("score"), F.col("critical")))


@query(W + "SELECT scan_id, CAST(round(avg(weight)) AS INT) AS score, count(*) AS n FROM f GROUP BY scan_id")
def chunk_merge(spark, sf):
    f = findings(spark, sf).select("scan_id", F.col("line").alias("chunk"), F.lit("").alias("summary"), F.lit("").alias("idea"), T.weight_of(F.col("severity")).alias("score"))
    merged = scans.merge_reports(f)
    return merged.join(f.groupBy("scan_id").agg(F.count("*").alias("n")), "scan_id").select("scan_id", "score", "n")
