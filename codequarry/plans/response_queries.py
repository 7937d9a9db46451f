"""Queries of model responses: turns of conversations as what a model might answer, in eight shapes; events as attempts to get one."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import attempts, responses
from codequarry.plans.surrogates import pick, sql_pick, table

QUERIES, ORACLE_SQL = {}, {}

GIVEN_TYPES = ["SQLi", "xss", "nonsense", "IDOR"]
GIVEN_LINES = ["7", '"L42-45"', '" 12 "', "3.9", "-4", "null", '"none"', "true"]


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def shaped(spark, sf):
    """A response a turn: whole, fenced, a list, inside prose with braces, cut off, closed but malformed, no JSON, another key."""
    n = F.col("conv_id") * 7 + F.col("turn")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)  # the text as a JSON string
    item = F.concat(
        F.lit('{"type": "'), pick(GIVEN_TYPES, F.floor(n / 8) % 4), F.lit('", "location": "app/F'), (n % 13).cast("string"), F.lit('.php", "line": '), pick(GIVEN_LINES, F.floor(n / 32) % 8),
        F.lit(', "severity": "High", "description": "d", "proof": '), quoted, F.lit("}"),
    )
    whole = F.concat(F.lit('{"summary": "s", "vulnerabilities": ['), item, F.lit(', 5, {"type": "xss"}], "overall_score": "44.7"}'))
    shapes = [
        whole,
        F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n```\nDone {")),
        F.concat(F.lit("["), item, F.lit("]")),
        F.concat(F.lit('I read the { handler, {"other": {"vulnerabilities": 1}} and "quoted: '), whole, F.lit(" } and so on {")),
        F.concat(F.lit('{"vulnerabilities" : [ '), item, F.lit(', {"type": "ss')),
        F.concat(F.lit('{"a": [{}], "vulnerabilities": ['), item, F.lit(', {"type": "xss", }], "overall_score": 5}')),
        F.lit('no JSON, only { braces } and {"a'),
        F.lit('{"findings": []}'),
    ]
    shape = F.coalesce(*[F.when(n % 8 == i, s) for i, s in enumerate(shapes)])
    return table(spark, sf, "conversations").select("conv_id", "turn", shape.alias("response"))


SHAPED = f"""r AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id * 7 + turn) % 8 AS shape, {sql_pick(GIVEN_TYPES, "(conv_id * 7 + turn) // 8 % 4")} AS given,
  CAST(['7', '42', '12', '3', '1', '1', '1', '1'][CAST((conv_id * 7 + turn) // 32 % 8 AS INT) + 1] AS INT) AS line, 'app/F' || ((conv_id * 7 + turn) % 13) || '.php' AS location FROM conversations)"""


@query(f"""WITH {SHAPED} SELECT conv_id, turn, CASE WHEN shape < 4 OR shape = 5 THEN 'ok' WHEN shape = 4 THEN 'truncated' ELSE 'failed' END AS state,
  CASE WHEN shape IN (0, 1, 3) THEN 3 WHEN shape IN (2, 4, 5) THEN 1 END AS entries FROM r""")
def response_states(spark, sf):
    parsed = responses.parse(shaped(spark, sf))
    return parsed.select("conv_id", "turn", "state", F.when(F.col("elements").isNotNull(), F.size("elements")).alias("entries"))


@query(f"""WITH {SHAPED} SELECT conv_id, turn, CASE given WHEN 'SQLi' THEN 'sql_injection' ELSE lower(given) END AS type, location, line, 'high' AS severity, md5(text) AS proof
  FROM r WHERE shape < 6 AND given <> 'nonsense'""")
def response_findings(spark, sf):
    found, _ = responses.to_findings(responses.parse(shaped(spark, sf)), ("conv_id", "turn"))
    return found.select("conv_id", "turn", "type", "location", "line", "severity", F.md5(F.col("proof").cast("binary")).alias("proof"))


@query(f"""WITH {SHAPED} SELECT conv_id, turn, 0 AS ordinal, 'unknown type' AS reason FROM r WHERE shape < 6 AND given = 'nonsense'
UNION ALL SELECT conv_id, turn, 0, 'no such file' FROM r WHERE shape < 6 AND given <> 'nonsense' AND location IN ('app/F4.php', 'app/F9.php')
UNION ALL SELECT conv_id, turn, 1, 'not an object' FROM r WHERE shape IN (0, 1, 3) UNION ALL SELECT conv_id, turn, 2, 'no location' FROM r WHERE shape IN (0, 1, 3)""")
def response_rejects(spark, sf):
    """Entries that go, with the reason; of thirteen files two are not there."""
    files = table(spark, sf, "conversations").select(((F.col("conv_id") * 7 + F.col("turn")) % 13).alias("n")).distinct().where("n not in (4, 9)")
    files = files.select(F.concat(F.lit("app/F"), F.col("n").cast("string"), F.lit(".php")).alias("path"), F.lit(5).alias("lines"))
    _, gone = responses.to_findings(responses.parse(shaped(spark, sf)), ("conv_id", "turn"), files)
    return gone.select("conv_id", "turn", "ordinal", "reason")


@query(f"""WITH {SHAPED} SELECT conv_id, turn, CASE WHEN shape IN (0, 1, 3) THEN 44 WHEN given = 'nonsense' THEN 100 ELSE 80 END AS score,
  CASE WHEN shape IN (0, 1, 3) THEN 's' WHEN shape = 4 THEN 'The response was cut off; ' || CAST(given <> 'nonsense' AS INT) || ' whole findings were recovered, later files may not have been analysed.' ELSE '' END AS summary FROM r WHERE shape < 6""")
def response_heads(spark, sf):
    parsed = responses.parse(shaped(spark, sf))
    found, _ = responses.to_findings(parsed, ("conv_id", "turn"))
    return responses.report_heads(parsed, found, ("conv_id", "turn")).select("conv_id", "turn", "score", "summary")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS ok, CASE event_type WHEN 'error' THEN 404 WHEN 'click' THEN 429 WHEN 'view' THEN 503 END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
l AS (SELECT *, place - coalesce(max(CASE WHEN ok OR status = 404 THEN place END) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM e),
a AS (SELECT *, CAST((p - 1) % 5 + 1 AS INT) AS attempt FROM l),
s AS (SELECT *, CASE WHEN ok THEN 'ok' WHEN status = 404 THEN 'refused' WHEN attempt = 5 THEN 'gave_up' ELSE 'retried' END AS state FROM a)
SELECT user_id, event_id, place - attempt + 1 AS first, attempt, state,
  CASE WHEN state = 'retried' THEN (CASE WHEN status = 429 THEN [15, 30, 60, 120] ELSE [2, 4, 8, 16] END)[attempt] END AS wait FROM s""")
def retried_requests(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", 404).when(kind == "click", 429).when(kind == "view", 503)
    log = table(spark, sf, "events").select("user_id", "ts", "event_id", (kind == "purchase").alias("ok"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    return attempts.requests(log, ("user_id",), ("ts", "event_id")).select("user_id", "event_id", "first", "attempt", "state", "wait")
