"""Queries over names, paths, descriptions, traces and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry import registry as R
from codequarry.functions import rules, text as T
from codequarry.plans.surrogates import pick, sql_pick, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def q(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def matches(col: str, patterns) -> str:
    return f"regexp_matches({col}, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


# --- paths --------------------------------------------------------------------

PATHS = ["app/Models/User.php", "vendor/acme/x.php", "packages/vendor/y.php", "app/vendors/z.php", "storage/logs/a.log", "config/.env.local", "keys/server.pem", "tests/Unit/ATest.php", "app/Http/Controllers/HomeController.php", "./routes/web.php", "/app/tests/b.php", "node_modules/c/d.php", "app\\Http\\Kernel.php", "storage/logs/deep/b.php", "app/id.key"]


def paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", pick(PATHS, F.col("p_partkey") % len(PATHS)).alias("path"))


P = f"p AS (SELECT p_partkey, {sql_pick(PATHS, f'p_partkey % {len(PATHS)}')} AS path FROM part)"


@query(f"WITH {P} SELECT p_partkey, regexp_replace(regexp_replace(replace(path, '\\', '/'), '^(\\./)+', ''), '^/+', '') AS path FROM p")
def path_normalise(spark, sf):
    return paths(spark, sf).select("p_partkey", T.normal_path(F.col("path")).alias("path"))


@query(f"WITH {P} SELECT p_partkey, path FROM p WHERE NOT regexp_matches(path, '(?:^|/)vendor(?:/|$)|(?:^|/)node_modules(?:/|$)|(?:^|/)tests(?:/|$)')")
def exclude_glob(spark, sf):
    return paths(spark, sf).where(~rules.excluded(F.col("path"), R.EngineConfig.exclude))


@query(f"WITH {P} SELECT p_partkey, path, regexp_matches(path, '(^|/)(\\.env[^/]*|[^/]*\\.key|[^/]*\\.pem)$') OR path LIKE 'storage/logs/%' OR path LIKE '%/storage/logs/%' AS walk, regexp_matches(path, '^(?s:\\.env.*|.*\\.key|.*\\.pem|storage/logs/.*)$') OR regexp_matches(path, '(^|/)(\\.env[^/]*|[^/]*\\.key|[^/]*\\.pem)$') AS diff FROM p")
def sensitive_path(spark, sf):
    c = F.col("path")
    return paths(spark, sf).select("p_partkey", "path", rules.sensitive(c, R.EngineConfig.sensitive_patterns).alias("walk"), rules.sensitive_in_diff(c, R.EngineConfig.sensitive_patterns).alias("diff"))


@query(f"WITH {P} SELECT p_partkey FROM p WHERE path = 'app/Models' OR starts_with(path, 'app/Models/') OR starts_with(path, 'routes/')")
def within_scan_path(spark, sf):
    return paths(spark, sf).where(rules.within(F.col("path"), ["app/Models/", "routes"])).select("p_partkey")


@query(f"WITH {P} SELECT p_partkey, p_size, path FROM p JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey) WHERE path LIKE '%.php' AND p_size <= 25 AND NOT regexp_matches(path, '(?:^|/)vendor(?:/|$)')")
def file_predicates(spark, sf):
    sized = table(spark, sf, "part").select("p_partkey", "p_size", pick(PATHS, F.col("p_partkey") % len(PATHS)).alias("path"))
    return sized.where(F.col("path").endswith(".php") & (F.col("p_size") <= 25) & ~rules.excluded(F.col("path"), ["*/vendor/*"]))


@query(f"""WITH {P}, c AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'HomeController' WHEN p_partkey % 4 = 2 THEN 'User' ELSE 'Thing' END AS cls, CASE WHEN p_partkey % 3 = 0 THEN 'App\\Model' WHEN p_partkey % 3 = 1 THEN 'FormRequest' ELSE '' END AS sup FROM p)
SELECT p_partkey, CASE WHEN starts_with(path, 'routes/') OR contains(path, '/routes/') THEN 'route' WHEN cls IS NULL THEN 'other' WHEN sup LIKE '%Model' THEN 'model' WHEN sup = 'FormRequest' THEN 'request' WHEN cls LIKE '%Controller' OR starts_with(path, 'app/Http/Controllers/') THEN 'controller' WHEN starts_with(path, 'app/Models/') THEN 'model' ELSE 'other' END AS kind FROM c""")
def file_types(spark, sf):
    k = F.col("p_partkey")
    cls = F.when(k % 4 == 0, None).when(k % 4 == 1, "HomeController").when(k % 4 == 2, "User").otherwise("Thing")
    sup = F.when(k % 3 == 0, "App\\Model").when(k % 3 == 1, "FormRequest").otherwise("")
    return paths(spark, sf).select("p_partkey", rules.file_type(F.col("path"), cls, sup).alias("kind"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9/._~-]', 'x', 'g') AS shape, strlen(url) AS n FROM pages")
def url_shape(spark, sf):
    enc = T.encode_path(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(enc, "%[0-9A-F]{2}", "x").alias("shape"), F.octet_length("url").cast("long").alias("n"))


# --- names --------------------------------------------------------------------

NAMES = ["password", "api_key", "sort_key", "public_key", "license_key", "user_token", "csrf_token", "session_hash", "password_hash", "name", "is_admin", "is_active", "is_featured", "is_owner", "can_publish", "site_admin", "user_id", "status", "subscription_level", "subscribed", "bonus_credits", "paid", "Webhook-URL", "callback", "title", "role", "secret_note_hash", "client_secret", "foreign_key", "verified"]
NM = f"n AS (SELECT p_partkey, p_size, {sql_pick(NAMES, f'p_partkey % {len(NAMES)}')} AS name FROM part)"


def names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", pick(NAMES, F.col("p_partkey") % len(NAMES)).alias("name"))


@query(f"WITH {NM} SELECT p_partkey, name, CASE WHEN lower(name) IN {q(R.NOT_SECRET)} THEN false WHEN lower(name) IN {q(R.SENSITIVE_EXACT)} THEN true WHEN lower(name) LIKE '%\\_secret' ESCAPE '\\' OR lower(name) LIKE '%\\_token' ESCAPE '\\' THEN true WHEN lower(name) LIKE '%\\_key' ESCAPE '\\' THEN {contains('lower(name)', R.SECRET_KEY_WORDS)} WHEN lower(name) LIKE '%\\_hash' ESCAPE '\\' THEN contains(name, 'password') OR contains(name, 'secret') ELSE false END AS sensitive FROM n")
def sensitive_attrs(spark, sf):
    return names(spark, sf).select("p_partkey", "name", rules.secret_name(F.col("name")).alias("sensitive"))


@query(f"""WITH {NM} SELECT p_partkey, name, CASE WHEN name IN {q(R.ALWAYS_PRIVILEGE)} THEN 'high' WHEN name IN {q(R.AUTH_STATE)} THEN CASE WHEN p_size % 2 = 0 THEN 'high' END WHEN name IN {q(R.AMBIGUOUS_PRIVILEGE)} THEN CASE WHEN p_size % 3 = 0 THEN 'medium' END WHEN name IN {q(R.OWNERSHIP_FIELDS)} THEN 'high'
  WHEN name NOT IN {q(R.BENIGN_FLAGS)} AND (starts_with(name, 'is_') OR starts_with(name, 'can_') OR suffix(name, '_admin')) THEN CASE WHEN p_size % 3 = 0 THEN 'high' END WHEN starts_with(name, 'subscription') OR name = 'subscribed' OR suffix(name, '_credits') THEN 'medium' END AS severity FROM n""")
def privilege_fields(spark, sf):
    return names(spark, sf).select("p_partkey", "name", rules.privilege_field(F.col("name"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("severity"))


@query(f"WITH {NM} SELECT name, suffix(lower(name), 'id') AS id_like, {contains("lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))", R.URL_WORDS)} AS url_like, lower(name) IN {q(R.AUTHORIZATION_METHODS)} OR {contains('lower(name)', R.AUTHORIZATION_FRAGMENTS)} AS authorizes, count(*) AS n FROM n GROUP BY ALL")
def name_rules(spark, sf):
    c = F.col("name")
    return names(spark, sf).groupBy("name", rules.identifier_like(c).alias("id_like"), rules.url_word(c).alias("url_like"), rules.authorization_name(c).alias("authorizes")).agg(F.count("*").alias("n"))


MIDDLEWARE = ["web", "auth:api", "throttle:60,1", "can:update,post", "App\\Http\\Middleware\\TrimStrings", "role:admin"]


@query(f"SELECT p_partkey, regexp_replace(lower(split_part(m1, ':', 1)), '^.*\\\\', '') IN {q(R.INERT_MIDDLEWARE)} AND regexp_replace(lower(split_part(m2, ':', 1)), '^.*\\\\', '') IN {q(R.INERT_MIDDLEWARE)} AS inert FROM (SELECT p_partkey, {sql_pick(MIDDLEWARE, 'p_partkey % 6')} AS m1, {sql_pick(MIDDLEWARE, 'p_size % 6')} AS m2 FROM part)")
def inert_middleware(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", rules.inert(F.array(pick(MIDDLEWARE, F.col("p_partkey") % 6), pick(MIDDLEWARE, F.col("p_size") % 6))).alias("inert"))


CALLS = ["input", "Validated", "ip", "header", "merge", "old", "config", "trim", "mystery", "sprintf", "session", "only"]


@query(f"""SELECT name, CASE WHEN lower(name) IN {q(R.VALIDATED_ACCESSORS)} THEN 'validated' WHEN lower(name) IN {q(R.TAINTED_ACCESSORS)} THEN 'tainted' WHEN lower(name) IN {q(R.TRUSTED_ACCESSORS)} THEN 'trusted' ELSE 'unknown' END AS accessor,
  CASE WHEN lower(name) IN {q(R.TRUSTED_FUNCTIONS)} THEN 'trusted' WHEN lower(name) IN {q(R.TAINTED_FUNCTIONS)} THEN 'tainted' WHEN lower(name) IN {q(R.PRESERVING_FUNCTIONS)} THEN 'preserving' ELSE 'unknown' END AS function, count(*) AS n FROM (SELECT {sql_pick(CALLS, 'p_partkey % 12')} AS name FROM part) GROUP BY ALL""")
def call_trust(spark, sf):
    c = F.col("name")
    return table(spark, sf, "part").select(pick(CALLS, F.col("p_partkey") % 12).alias("name")).groupBy("name", rules.accessor_trust(c).alias("accessor"), rules.function_trust(c).alias("function")).agg(F.count("*").alias("n"))


# --- severities and types -------------------------------------------------------

WORDS = ["Critical", " severe", "P0", "major", "HIGH", "moderate", "warning", "info", "trivial", "???", "", "low", "blocker"]


@query(f"SELECT word, CASE WHEN w IN ('critical', 'severe', 'crit', 'blocker', 'p0') THEN 'critical' WHEN w IN ('high', 'important', 'major', 'serious') THEN 'high' WHEN w IN ('medium', 'moderate', 'med', 'warning') THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM (SELECT word, lower(trim(word)) AS w FROM (SELECT {sql_pick(WORDS, f'p_partkey % {len(WORDS)}')} AS word FROM part)) GROUP BY ALL")
def severity_alias(spark, sf):
    return table(spark, sf, "part").select(pick(WORDS, F.col("p_partkey") % len(WORDS)).alias("word")).groupBy("word", T.severity_of(F.col("word")).alias("severity")).agg(F.count("*").alias("n"))


SPELLINGS = ["SQL Injection", "sqli", "Cross-Site Scripting (XSS)", "Stored XSS", "stored  xss", "IDOR", "Broken Access Control", "massassignment", "Mass-Assignment", "RCE", "directory/traversal", "Hard-coded Secret", "unknown thing", "Server-Side Request Forgery (SSRF)", "Weird (csrf)", "open redirect.", ""]


@query(f"""WITH s AS (SELECT {sql_pick(SPELLINGS, f'p_partkey % {len(SPELLINGS)}')} AS spelling FROM part), k(w, type, pr) AS (VALUES {R.sql_values(R.type_spellings())}),
c AS (SELECT DISTINCT spelling, spelling AS a, regexp_extract(spelling, '^(.*?)\\(([^)]*)\\)\\s*$', 1) AS b, regexp_extract(spelling, '^(.*?)\\(([^)]*)\\)\\s*$', 2) AS d FROM s),
t AS (SELECT spelling, n, regexp_replace(regexp_replace(lower(trim(x)), '[\\s\\-_/]+', '_', 'g'), '^[_.:]+|[_.:]+$', '', 'g') AS w FROM (SELECT spelling, 1 AS n, a AS x FROM c UNION ALL SELECT spelling, 3, b FROM c UNION ALL SELECT spelling, 5, d FROM c)),
u AS (SELECT spelling, n, w FROM t UNION ALL SELECT spelling, n + 1, replace(w, '_', '') FROM t),
r AS (SELECT spelling, arg_min(type, n) AS type FROM u JOIN k USING (w) GROUP BY spelling)
SELECT s.spelling, r.type, count(*) AS n FROM s LEFT JOIN r USING (spelling) GROUP BY ALL""")
def type_alias(spark, sf):
    return table(spark, sf, "part").select(pick(SPELLINGS, F.col("p_partkey") % len(SPELLINGS)).alias("spelling")).groupBy("spelling", T.type_of(F.col("spelling")).alias("type")).agg(F.count("*").alias("n"))


# --- values -------------------------------------------------------------------

VALUES = ["12", " 7 ", "line 42", "3.9", "none", "-5", "0", "L18-L20", "", "99999"]


@query(f"SELECT p_partkey, least(greatest(1, coalesce(try_cast(trim(v) AS BIGINT), try_cast(regexp_extract(trim(v), '\\d+') AS BIGINT), 1)), greatest(CAST(p_size AS BIGINT) * 3, 1)) AS line FROM (SELECT p_partkey, p_size, CASE WHEN v = '3.9' THEN '3' ELSE v END AS v FROM (SELECT p_partkey, p_size, {sql_pick(VALUES, 'p_partkey % 10')} AS v FROM part))")
def coerce_line(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.to_line(pick(VALUES, F.col("p_partkey") % 10), F.col("p_size") * 3).alias("line"))


FLAGS = ["true", "Yes", "1", "no", "FALSE", "0", "maybe", ""]


@query(f"SELECT v, CASE WHEN lower(v) IN ('true', 'yes', '1') THEN true WHEN lower(v) IN ('false', 'no', '0') THEN false END AS flag, count(*) AS n FROM (SELECT {sql_pick(FLAGS, 'p_partkey % 8')} AS v FROM part) GROUP BY ALL")
def coerce_boolean(spark, sf):
    return table(spark, sf, "part").select(pick(FLAGS, F.col("p_partkey") % 8).alias("v")).groupBy("v", T.to_bool(F.col("v")).alias("flag")).agg(F.count("*").alias("n"))


SCORES = ["88", "150", "-3", "n/a", " 42.7 ", ""]


@query(f"SELECT p_partkey, CAST(CASE WHEN try_cast(trim(v) AS DOUBLE) IS NULL THEN greatest(0, 100 - p_size * 3) ELSE greatest(0, least(100, trunc(try_cast(trim(v) AS DOUBLE)))) END AS INT) AS score FROM (SELECT p_partkey, p_size, {sql_pick(SCORES, 'p_partkey % 6')} AS v FROM part)")
def coerce_score(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.to_score(pick(SCORES, F.col("p_partkey") % 6), F.col("p_size") * 3).alias("score"))


EXPLOITS = ["n/a", "https://example.org/x?id=1", "<script>", "curl -X POST /users/2", "abc", "None", "GET /orders/7 as another user"]


@query(f"SELECT exploit, exploit NOT IN ('') AND lower(exploit) NOT IN {q(R.PLACEHOLDER_EXPLOITS)} AND NOT regexp_matches(exploit, '^\\s*https?://\\S+\\s*$', 'i') AND NOT regexp_matches(exploit, '^<[^>]+>$') AND strlen(exploit) >= 5 AS substantive, count(*) AS n FROM (SELECT {sql_pick(EXPLOITS, 'p_partkey % 7')} AS exploit FROM part) GROUP BY ALL")
def exploit_filter(spark, sf):
    return table(spark, sf, "part").select(pick(EXPLOITS, F.col("p_partkey") % 7).alias("exploit")).groupBy("exploit", rules.substantive(F.col("exploit")).alias("substantive")).agg(F.count("*").alias("n"))


# --- descriptions and traces ------------------------------------------------------

SAID = [
    "User input reaches the query.", "This is not a vulnerability because ids are checked.", "The value is cast to int, which makes it safe.", "Already mitigated, but the architecture is fragile.",
    "However the integer cast protects it; not directly exploitable.", "On closer inspection the field is properly validated.", "The token leaks into logs.", "Although the guard prevents abuse, the risk remains.",
]


@query(f"""SELECT p_partkey, said FROM (SELECT p_partkey, {sql_pick(SAID, 'p_partkey % 8')} AS said FROM part) WHERE NOT ({contains('lower(said)', R.STRONG_DISMISSALS)} OR {matches('said', R.STRONG_PATTERNS)}
  OR (({contains('lower(said)', R.WEAK_DISMISSALS)} OR {matches('said', R.WEAK_PATTERNS)}) AND NOT ({contains('lower(said)', R.RESCUES)} OR {matches('lower(said)', R.RESCUE_PATTERNS)})))""")
def contradiction_filter(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", pick(SAID, F.col("p_partkey") % 8).alias("said"))
    return p.where(~rules.contradicts_itself(F.col("said")))


TRACES = [
    "source: $request->input('q') → transforms: none → sink: DB::raw", "source: config('app.url') → sink: redirect", "source: $request->id → transforms: intval → sink: where", "source: $_GET['u'] → transforms: htmlspecialchars → sink: echo",
    "source: Auth::id() → sink: query", "source: $request->url → transforms: parse_url check → sink: redirect", "no trace", "source: $request->x → transforms: validated() → sink: raw",
]
TRACED = ["sql_injection", "xss", "open_redirect", "idor"]


@query(f"""WITH t AS (SELECT p_partkey, {sql_pick(TRACED, '(p_partkey // 8) % 4')} AS type, lower({sql_pick(TRACES, 'p_partkey % 8')}) AS low FROM part),
s AS (SELECT *, trim(regexp_extract(low, 'source:\\s*(.+?)(?:\\s*→|$)', 1)) AS src, trim(regexp_extract(low, 'transforms:\\s*(.+?)(?:\\s*→|$)', 1)) AS done FROM t)
SELECT p_partkey, type FROM s WHERE NOT (type IN {q(R.TRACED_TYPES)} AND ((src <> '' AND ({contains('src', R.SAFE_SOURCES)} OR regexp_matches(src, '{"|".join(R.SAFE_SOURCE_PATTERNS)}')))
  OR (done NOT IN ('', 'none') AND ({contains('done', R.BREAKERS[''])} OR (type = 'sql_injection' AND {contains('done', R.BREAKERS['sql_injection'])}) OR (type = 'xss' AND {contains('done', R.BREAKERS['xss'])}) OR (type = 'open_redirect' AND {contains('done', R.BREAKERS['open_redirect'])})))))""")
def taint_trace_filter(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", pick(TRACED, F.floor(k / 8) % 4).alias("type"), pick(TRACES, k % 8).alias("trace"))
    return p.where(~rules.broken_trace(F.col("type"), F.col("trace"))).select("p_partkey", "type")


@query("SELECT doc_id, sha256(t) AS redacted, contains(t, '__REDACTED_SECRET__') AS found FROM (SELECT doc_id, regexp_replace(text, '(?i)\\b(password|passwd|secret|api_key|apikey|token|access_key)([\"'']?\\s*(?:=>|=|:)\\s*[\"'']?)[^\\s\"'',;]{6,}', '\\1\\2__REDACTED_SECRET__', 'g') AS t FROM documents)")
def redact_secrets(spark, sf):
    t = T.redact(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("redacted"), t.contains("__REDACTED_SECRET__").alias("found"))


@query("SELECT doc_id, CASE WHEN len(ls) >= 2 THEN trim(regexp_replace(ls[2], '\\s+', ' ', 'g')) END AS second, CASE WHEN len(ls) >= 4000 THEN 'x' END AS far FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def line_content(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.line_content(F.col("text"), F.lit(2)).alias("second"), F.when(T.line_content(F.col("text"), F.lit(4000)).isNotNull(), "x").alias("far"))


@query("SELECT doc_id, CAST(CASE WHEN contains(text, ' the ') THEN length(split_part(text, ' the ', 1)) - length(replace(split_part(text, ' the ', 1), chr(10), '')) + 1 ELSE 1 END AS INT) AS line FROM documents")
def line_of_needle(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.line_at(F.col("text"), F.lit(" the ")).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 280 THEN left(text, 277) || '...' ELSE text END AS short FROM documents")
def shorten(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.shorten(F.col("text"), 280).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_fields(spark, sf):
    return table(spark, sf, "events").where(F.expr("try_parse_json(props) is not null")).select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))
