"""Predicates over names, paths, descriptions and traces: Column in, boolean Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry import registry as R
from codequarry.functions.text import any_match, any_of


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored pattern in which * crosses slashes."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
    return f"^(?s:{out})$"


def segment_pattern(glob: str) -> str | None:
    """An exclude glob as a pattern over whole path segments; None for one that says nothing."""
    body = re.sub(r"^(?:\*/|/)+", "", glob.strip().replace("\\", "/"))
    body = re.sub(r"(?:/\*|/)+$", "", body)
    if body in ("", "*"):
        return None
    return "(?:^|/)" + re.escape(body).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "(?:/|$)"


def excluded(path: Column, globs) -> Column:
    patterns = [p for p in map(segment_pattern, globs) if p]
    return path.rlike("|".join(patterns)) if patterns else F.lit(False)


def sensitive(path: Column, globs) -> Column:
    """Walk flavour: a pattern with a slash covers a folder, one without the file name."""
    name = F.substring_index(path, "/", -1)
    out = F.lit(False)
    for g in globs:
        if "/" in g:
            folder = g.strip("*/")
            out = out | (path == folder) | path.startswith(folder + "/") | F.concat(F.lit("/"), path).contains(f"/{folder}/") | path.rlike(glob_pattern(g))
        else:
            out = out | name.rlike(glob_pattern(g))
    return out


def sensitive_in_diff(path: Column, globs) -> Column:
    """Diff flavour: a pattern fits the whole path or the file name."""
    pattern = "|".join(map(glob_pattern, globs))
    return path.rlike(pattern) | F.substring_index(path, "/", -1).rlike(pattern) if globs else F.lit(False)


def within(path: Column, roots) -> Column:
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        out = out | (path == r) | path.startswith(r + "/")
    return out


def binary(content: Column) -> Column:
    """A NUL in the first 8192 bytes; null (unreadable) counts as binary."""
    return F.coalesce(F.position(F.lit(bytearray(b"\0")), F.substring(content, 1, 8192)) > 0, F.lit(True))


def contradicts_itself(text: Column) -> Column:
    low = F.lower(text)
    strong = any_of(low, R.STRONG_DISMISSALS) | any_match(text, R.STRONG_PATTERNS)
    weak = any_of(low, R.WEAK_DISMISSALS) | any_match(text, R.WEAK_PATTERNS)
    rescued = any_of(low, R.RESCUES) | any_match(low, R.RESCUE_PATTERNS)
    return F.coalesce(strong | (weak & ~rescued), F.lit(False))


def broken_trace(type_: Column, trace: Column) -> Column:
    """A trace whose source is no user input, or whose transforms break the chain."""
    low = F.lower(trace)
    part = lambda name: F.trim(F.regexp_extract(low, rf"{name}:\s*(.+?)(?:\s*→|$)", 1))
    source, done = part("source"), part("transforms")
    safe = (source != "") & (any_of(source, R.SAFE_SOURCES) | source.rlike("|".join(R.SAFE_SOURCE_PATTERNS)))
    broken = any_of(done, R.BREAKERS[""])
    for t in ("sql_injection", "xss", "open_redirect"):
        broken = broken | ((type_ == t) & any_of(done, R.BREAKERS[t]))
    return F.coalesce(type_.isin(R.TRACED_TYPES) & (safe | (~done.isin("", "none") & broken)), F.lit(False))


def substantive(exploit: Column) -> Column:
    return F.coalesce(~F.lower(exploit).isin("", *R.PLACEHOLDER_EXPLOITS) & ~exploit.rlike(r"(?i)^\s*https?://\S+\s*$") & ~exploit.rlike("^<[^>]+>$") & (F.octet_length(exploit) >= 5), F.lit(False))


def inert(middleware: Column) -> Column:
    """Whether every middleware of an array is known to authorize nothing."""
    short = lambda m: F.lower(F.substring_index(F.substring_index(m, ":", 1), "\\", -1))
    return F.forall(middleware, lambda m: short(m).isin(R.INERT_MIDDLEWARE))


def secret_name(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.isin(R.NOT_SECRET), False).when(n.isin(R.SENSITIVE_EXACT), True).when(n.endswith("_secret") | n.endswith("_token"), True)
        .when(n.endswith("_key"), any_of(n, R.SECRET_KEY_WORDS)).when(n.endswith("_hash"), n.contains("password") | n.contains("secret")).otherwise(False)
    )


def privilege_field(name: Column, authenticates: Column, corroborated: Column) -> Column:
    """Severity of a writable privilege field, null when it is none."""
    flag = ~name.isin(R.BENIGN_FLAGS) & (name.startswith("is_") | name.startswith("can_") | name.endswith("_admin"))
    return (
        F.when(name.isin(R.ALWAYS_PRIVILEGE), "high").when(name.isin(R.AUTH_STATE), F.when(authenticates, "high"))
        .when(name.isin(R.AMBIGUOUS_PRIVILEGE), F.when(corroborated, "medium")).when(name.isin(R.OWNERSHIP_FIELDS), "high")
        .when(flag, F.when(corroborated, "high")).when(name.startswith("subscription") | (name == "subscribed") | name.endswith("_credits"), "medium")
    )


def identifier_like(name: Column) -> Column:
    return F.lower(name).endswith("id")


def url_word(name: Column) -> Column:
    return any_of(F.lower(F.regexp_replace(name, "(?i)[^a-z0-9]", "")), R.URL_WORDS)


def authorization_name(name: Column) -> Column:
    n = F.lower(name)
    return n.isin(R.AUTHORIZATION_METHODS) | any_of(n, R.AUTHORIZATION_FRAGMENTS)


def accessor_trust(method: Column) -> Column:
    """Trust of a request accessor."""
    m = F.lower(method)
    return F.when(m.isin(R.VALIDATED_ACCESSORS), "validated").when(m.isin(R.TAINTED_ACCESSORS), "tainted").when(m.isin(R.TRUSTED_ACCESSORS), "trusted").otherwise("unknown")


def function_trust(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.isin(R.TRUSTED_FUNCTIONS), "trusted").when(n.isin(R.TAINTED_FUNCTIONS), "tainted").when(n.isin(R.PRESERVING_FUNCTIONS), "preserving").otherwise("unknown")


def file_type(path: Column, class_: Column, parent: Column) -> Column:
    """Kind of a source file from its path and class declaration."""
    short = F.coalesce(F.substring_index(parent, "\\", -1), F.lit(""))
    under = lambda d: path.startswith(d + "/") | path.contains(f"/{d}/")
    return (
        F.when(path.startswith("routes/") | path.contains("/routes/"), "route").when(class_.isNull(), "other")
        .when(short.endswith("Controller"), "controller").when(short.isin("Model", "Authenticatable", "Pivot", "MorphPivot", "User"), "model")
        .when(short.endswith("FormRequest"), "request").when(short == "Middleware", "middleware")
        .when(class_.endswith("Controller") | under("app/Http/Controllers"), "controller").when(under("app/Models"), "model")
        .when(under("app/Http/Requests") | short.endswith("Request"), "request").when(under("app/Http/Middleware"), "middleware").otherwise("other")
    )


def middleware_summary(content: Column) -> Column:
    body = F.regexp_extract(content, r"(?s)function\s+handle\s*\([^)]*\)\s*(?::\s*\w+\s*)?\{(.*?)\n\s*\}", 1)
    first = F.trim(F.element_at(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), 1))
    has = lambda *words: any_of(body, words)
    return (
        F.when(F.trim(body) == "", "custom middleware").when(has("abort(403", "abort(401"), "Authorization check middleware").when(has("RateLimiter", "throttle"), "Rate limiting middleware")
        .when(has("Auth::check", "auth()->check"), "Authentication check middleware").when(has("redirect("), "Redirect middleware").when(has("$request->header", "hasHeader"), "Header validation middleware")
        .when(has("encrypt", "decrypt"), "Encryption middleware").when(has("log", "Log::"), "Logging middleware")
        .when(F.length(first) > 80, F.concat(F.left(first, F.lit(80)), F.lit("..."))).otherwise(first)
    )


def rate_limit_summary(body: Column) -> Column:
    p = r"Limit\s*::\s*per(Minute|Hour|Day)\s*\(\s*(\d+)\s*\)"
    return F.when(body.rlike(p), F.concat(F.regexp_extract(body, p, 2), F.lit(" per "), F.lower(F.regexp_extract(body, p, 1)))).when(body.contains("Limit::none()"), "unlimited").otherwise("custom rate limit")
