"""Queries over scans: coverage, usage, cost, chunks, history, accuracy."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import benchmark, scans
from codequarry.plans.surrogates import table
from codequarry.registry import SKIP_REASONS, sql_values

QUERIES, ORACLE_SQL = {}, {}

#: provider, model, input and output price of a million tokens, in the registry's order.
PRICES = [("view", "scan-large", 5.0, 25.0), ("view", "scan", 3.0, 15.0), ("click", "scan-small", 1.0, 5.0), ("purchase", "audit-2", 2.5, 10.0), ("error", "audit-2-mini", 0.15, 0.6)]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def files(spark, sf):
    reason = F.when(F.octet_length("text") == 0, "unreadable").when(F.col("n_chars") > 12000, "token_limit").when(F.col("n_chars") % 17 == 0, "ai_failure")
    return table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars", F.col("text").alias("content"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), reason.alias("reason"))


FILES = "d AS (SELECT source, lang, doc_id, n_chars, text AS content, source || '/' || doc_id AS path, CASE WHEN strlen(text) = 0 THEN 'unreadable' WHEN n_chars > 12000 THEN 'token_limit' WHEN n_chars % 17 = 0 THEN 'ai_failure' END AS reason FROM documents)"


@query(f"WITH {FILES} SELECT source, count(*) AS discovered, count(*) FILTER (reason IS NULL) AS analyzed, count(reason) AS skipped, CASE WHEN count(*) > 0 THEN round(least(100.0::DOUBLE, count(*) FILTER (reason IS NULL) / count(*) * 100), 1) ELSE 0.0::DOUBLE END AS percent_analyzed, count(reason) = 0 AS complete FROM d GROUP BY source")
def coverage_percent(spark, sf):
    return scans.coverage(files(spark, sf), ("source",))


@query(f"WITH {FILES}, l(reason, reason_label) AS (VALUES {sql_values(SKIP_REASONS.items())}) SELECT source, reason, string_agg(path, '|' ORDER BY path) AS paths, reason_label FROM d JOIN l USING (reason) GROUP BY ALL")
def skips_by_reason(spark, sf):
    return scans.skips(files(spark, sf), ("source",)).withColumn("paths", F.array_join("paths", "|"))


@query(f"WITH {FILES}, c AS (SELECT source, count(*) AS discovered, count(*) FILTER (reason IS NULL) AS analyzed FROM d GROUP BY source) SELECT source, CASE WHEN analyzed < discovered THEN 'coverage is incomplete' END AS suppression_reason, CASE WHEN analyzed >= discovered THEN 77 END AS score FROM c")
def score_suppressed(spark, sf):
    c = scans.coverage(files(spark, sf), ("source",)).withColumn("target_error", F.lit(None).cast("string")).withColumn("score", F.lit(77))
    return scans.suppressed_score(c).select("source", "suppression_reason", "score")


def log(spark, sf):
    tokens = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("provider"), "user_id", tokens.alias("prompt_tokens"), F.floor(tokens / 3).cast("long").alias("completion_tokens"), F.lit(1).cast("long").alias("requests"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")


LOG = "u AS (SELECT ts AS timestamp, event_type AS provider, user_id, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, CAST(floor(CAST(floor(value * 100) AS BIGINT) / 3) AS BIGINT) AS completion_tokens, 1 AS requests, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events)"
SUMS = "count(*) AS scans, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens, CAST(sum(requests) AS BIGINT) AS requests"


@query(f"WITH {LOG} SELECT provider, {SUMS} FROM u GROUP BY provider")
def usage_summary(spark, sf):
    return scans.usage_summary(log(spark, sf), ("provider",))


@query(f"WITH {LOG} SELECT provider, {SUMS} FROM u WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY provider")
def usage_since(spark, sf):
    since = F.lit(datetime.datetime(2024, 1, 20)).cast("timestamp_ntz")
    return scans.usage_summary(scans.usage_since(log(spark, sf), since), ("provider",))


@query(f"WITH {LOG}, p(provider, model, i, o) AS (VALUES {sql_values(PRICES)}), s AS (SELECT provider, CAST(sum(prompt_tokens) AS BIGINT) AS a, CAST(sum(completion_tokens) AS BIGINT) AS b FROM u GROUP BY provider) SELECT provider, model, round(CAST(a AS DOUBLE) / 1000000.0::DOUBLE * CAST(i AS DOUBLE) + CAST(b AS DOUBLE) / 1000000.0::DOUBLE * CAST(o AS DOUBLE), 4) AS usd FROM s JOIN p USING (provider)")
def cost_estimate(spark, sf):
    prices = spark.createDataFrame(PRICES, "provider string, model string, input double, output double")
    s = scans.usage_summary(log(spark, sf), ("provider",)).join(F.broadcast(prices), "provider")
    return s.select("provider", "model", scans.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("input"), F.col("output")).alias("usd"))


@query(f"WITH {LOG}, s AS (SELECT user_id, CAST(sum(prompt_tokens) AS BIGINT) AS used FROM u GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 5 > 0 THEN CAST(greatest(0, 400000 - used) AS BIGINT) END AS remaining, CASE WHEN user_id % 5 > 0 THEN round(used / 400000.0::DOUBLE * 100, 1) ELSE 0.0::DOUBLE END AS percent_used FROM s")
def limit_percent(spark, sf):
    s = log(spark, sf).groupBy("user_id").agg(F.sum("prompt_tokens").alias("used")).withColumn("limit", F.when(F.col("user_id") % 5 > 0, F.lit(400000).cast("long")).otherwise(F.lit(0).cast("long")))
    return s.select("user_id", *scans.limit_state(F.col("used"), F.col("limit")))


ASKED = ["scan-large", "scan-larger", "scan", "audit", "audit-2-mini-x", "other"]


@query(f"""WITH {LOG}, a AS (SELECT provider, [{", ".join(repr(x) for x in ASKED)}][CAST(k % 6 AS INT) + 1] AS model, count(*) AS n FROM u GROUP BY ALL), p(provider, model, i, o, ord) AS (VALUES {sql_values((*r, n) for n, r in enumerate(PRICES))}),
j AS (SELECT a.provider, a.model, n, p.model AS priced_as, CAST(i AS DOUBLE) AS input, CAST(o AS DOUBLE) AS output, row_number() OVER (PARTITION BY a.provider, a.model ORDER BY CASE WHEN a.provider = p.provider AND a.model = p.model THEN 1 WHEN a.provider = p.provider THEN 2 ELSE 3 END, ord) AS r
  FROM a LEFT JOIN p ON starts_with(p.model, a.model) OR starts_with(a.model, p.model)) SELECT provider, model, n, input, output, priced_as FROM j WHERE r = 1""")
def price_lookup(spark, sf):
    prices = spark.createDataFrame([(*r, n) for n, r in enumerate(PRICES)], "provider string, model string, input double, output double, ordinal int")
    model = F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("k") % 6 + 1).cast("int"))
    asked = log(spark, sf).groupBy("provider", model.alias("model")).agg(F.count("*").alias("n"))
    return scans.price_lookup(asked, prices).select("provider", "model", "n", "input", "output", "priced_as")


@query("SELECT source, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_estimate(spark, sf):
    return scans.tokens_by(table(spark, sf, "documents"), ("source",), "text")


CHUNKED = """WITH RECURSIVE d AS (SELECT doc_id // 500 AS scan, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS n FROM documents),
r(scan, n, doc_id, used, held, chunk) AS (SELECT scan, n, doc_id, size, 1, 0 FROM d WHERE n = 1 UNION ALL
  SELECT d.scan, d.n, d.doc_id, CASE WHEN r.used + d.size > 10240 OR r.held >= 10 THEN d.size ELSE r.used + d.size END, CASE WHEN r.used + d.size > 10240 OR r.held >= 10 THEN 1 ELSE r.held + 1 END, r.chunk + CASE WHEN r.used + d.size > 10240 OR r.held >= 10 THEN 1 ELSE 0 END
  FROM r JOIN d ON d.scan = r.scan AND d.n = r.n + 1)"""


def sized(spark, sf):
    return table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 500).alias("scan"), "doc_id", F.octet_length("text").alias("size"))


@query(CHUNKED + " SELECT scan, doc_id, CAST(chunk AS INT) AS chunk FROM r")
def greedy_chunks(spark, sf):
    return scans.fold_chunks(sized(spark, sf), ("scan",), "doc_id", int(4096 * 2.5), 10)


@query("""WITH RECURSIVE d AS (SELECT doc_id // 500 AS scan, doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS n FROM documents),
r(scan, n, doc_id, tokens, used, admitted) AS (SELECT scan, n, doc_id, tokens, CASE WHEN tokens + 4000 <= 60000 THEN tokens ELSE 0 END, tokens + 4000 <= 60000 FROM d WHERE n = 1 UNION ALL
  SELECT d.scan, d.n, d.doc_id, d.tokens, r.used + CASE WHEN r.used + d.tokens + 4000 <= 60000 THEN d.tokens ELSE 0 END, r.used + d.tokens + 4000 <= 60000 FROM r JOIN d ON d.scan = r.scan AND d.n = r.n + 1)
SELECT scan, doc_id, tokens, admitted FROM r""")
def budget_admission(spark, sf):
    chunks = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 500).alias("scan"), "doc_id", T.tokens(F.col("text")).alias("tokens"))
    return scans.admit(chunks, ("scan",), "doc_id", 60000)


@query("SELECT scan_id, score FROM (SELECT o_orderkey AS scan_id, CAST(o_orderkey % 101 AS INT) AS score FROM orders WHERE o_orderstatus = 'F') ORDER BY scan_id DESC LIMIT 20")
def recent_history(spark, sf):
    h = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scan_id"), (F.col("o_orderkey") % 101).cast("int").alias("score"))
    return scans.recent(h, 20, "scan_id")


@query("SELECT o_custkey AS target, count(*) AS scans, count(*) FILTER (o_orderpriority = '1-URGENT') AS with_critical, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def history_critical(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("target")).agg(F.count("*").alias("scans"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("with_critical"), F.max("o_orderkey").alias("latest"))


@query("SELECT conv_id AS chunk, 'm' || turn AS path, CASE WHEN role = 'system' AND turn % 2 = 1 THEN 'ai_failure' WHEN role = 'assistant' AND NOT contains(text, ' the ') THEN 'ai_failure' END AS reason FROM conversations")
def chunk_accounting(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").withColumn("chunk", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    held = F.when((F.col("role") == "system") & (F.col("turn") % 2 == 1), "failed").when(F.col("role") == "assistant", "truncated").otherwise("ok")
    responses = c.select("chunk", held.alias("state"), F.when(F.col("text").contains(" the "), F.array(F.concat(F.lit("m"), F.col("turn").cast("string")))).otherwise(F.expr("cast(array() as array<string>)")).alias("locations"))
    found = scans.chunk_coverage(c.select("chunk", F.concat(F.lit("m"), F.col("turn").cast("string")).alias("path")), responses)
    return found.select(F.split("chunk", "-")[0].cast("long").alias("chunk"), "path", "reason")


TAGGED = """t AS (SELECT l.doc_id, 'toxic' AS type, CASE WHEN toxic = 1 AND hit THEN 'tp' WHEN toxic = 1 THEN 'fn' WHEN hit THEN 'fp' END AS outcome FROM (SELECT doc_id, toxic, quality FROM labels) l JOIN (SELECT doc_id, regexp_matches(text, '(?i)\\b(idiot|moron|loser|scum)\\b') AS hit FROM documents) d ON l.doc_id = d.doc_id
UNION ALL SELECT l.doc_id, 'quality', CASE WHEN quality = 0 AND hit THEN 'tp' WHEN quality = 0 THEN 'fn' WHEN hit THEN 'fp' END FROM (SELECT doc_id, toxic, quality FROM labels) l JOIN (SELECT doc_id, contains(text, '!!') OR contains(text, ' | ') AS hit FROM documents) d ON l.doc_id = d.doc_id)"""


def tagged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").rlike(r"(?i)\b(idiot|moron|loser|scum)\b").alias("a"), (F.col("text").contains("!!") | F.col("text").contains(" | ")).alias("b"))
    j = table(spark, sf, "labels").join(d, "doc_id")
    kinds = F.array(F.struct(F.lit("toxic").alias("type"), (F.col("toxic") == 1).alias("bad"), F.col("a").alias("hit")), F.struct(F.lit("quality").alias("type"), (F.col("quality") == 0).alias("bad"), F.col("b").alias("hit")))
    x = j.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.*")
    return x.select("doc_id", "type", F.when(F.col("bad") & F.col("hit"), "tp").when(F.col("bad"), "fn").when(F.col("hit"), "fp").alias("outcome"))


COUNTS = "count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn"
PRF = "CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 4) END AS recall"


def prf_sql(by: str) -> str:
    group, keys = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"WITH {TAGGED}, c AS (SELECT {keys}{COUNTS} FROM t {group}), p AS (SELECT *, {PRF} FROM c) SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM p"


@query(prf_sql(""))
def prf_overall(spark, sf):
    return benchmark.prf(tagged(spark, sf))


@query(prf_sql("type"))
def prf_per_type(spark, sf):
    return benchmark.prf(tagged(spark, sf), ("type",))


@query("SELECT CAST(sum(n) AS BIGINT) AS expected, count(*) FILTER (n = 0) AS clean_files, count(*) AS files FROM (SELECT doc_id, count(*) FILTER (toxic = 1) AS n FROM labels GROUP BY doc_id)")
def truth_counts(spark, sf):
    return benchmark.truth_counts(table(spark, sf, "labels").select(F.col("doc_id").alias("file"), F.when(F.col("toxic") == 1, "toxic").alias("type")))


@query("SELECT a.l_orderkey % 500 AS file, a.l_suppkey % 25 AS type, a.l_linenumber AS line, count(*) AS candidates FROM lineitem a JOIN (SELECT DISTINCT l_orderkey % 500 AS f, l_suppkey % 25 AS t, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey % 500 = b.f AND a.l_suppkey % 25 = b.t AND abs(a.l_linenumber - b.n) <= 3 WHERE a.l_returnflag = 'A' GROUP BY ALL")
def label_candidates(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("file"), (F.col("l_suppkey") % 25).alias("type"), F.col("l_linenumber").alias("line"), "l_returnflag")
    labels = li.where("l_returnflag = 'R'").select(F.col("file").alias("f"), F.col("type").alias("t"), F.col("line").alias("n")).distinct()
    found = li.where("l_returnflag = 'A'")
    return found.join(labels, (F.col("file") == F.col("f")) & (F.col("type") == F.col("t")) & (F.abs(F.col("line") - F.col("n")) <= 3)).groupBy("file", "type", "line").agg(F.count("*").alias("candidates"))
