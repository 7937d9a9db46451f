"""Scalar text expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry import registry


def any_of(col: Column, words) -> Column:
    """Whether col contains one of the words, as one pattern."""
    return col.rlike("|".join(re.escape(w) for w in words))


def any_match(col: Column, patterns) -> Column:
    return col.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def fold_type(col: Column) -> Column:
    """Lower case, separators as one underscore, no outer _ . or :."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_/]+", "_"), r"^[_.:]+|[_.:]+$", "")


def type_of(col: Column) -> Column:
    """The type a spelling names, else null: as written, before a final parenthesis, inside it."""
    known = F.create_map(*[F.lit(x) for s, v, _ in registry.type_spellings() for x in (s, v)])
    outer, inner = F.regexp_extract(col, r"^(.*?)\(([^)]*)\)\s*$", 1), F.regexp_extract(col, r"^(.*?)\(([^)]*)\)\s*$", 2)
    tries = []
    for c in (col, outer, inner):
        folded = fold_type(c)
        tries += [F.try_element_at(known, folded), F.try_element_at(known, F.replace(folded, F.lit("_"), F.lit("")))]
    return F.coalesce(*tries)


def severity_of(col: Column) -> Column:
    """Severity by name or alias; anything else is low."""
    word = F.lower(F.trim(col))
    out = None
    for s, *_ in registry.SEVERITIES:
        fits = word.isin(s, *registry.SEVERITY_ALIASES[s])
        out = F.when(fits, s) if out is None else out.when(fits, s)
    return out.otherwise("low")


def weight_of(severity: Column) -> Column:
    out = None
    for s, w, *_ in registry.SEVERITIES:
        out = F.when(severity == s, w) if out is None else out.when(severity == s, w)
    return out.otherwise(0)


def level_of(severity: Column) -> Column:
    return F.when(weight_of(severity) >= 20, "error").when(weight_of(severity) >= 10, "warning").otherwise("note")


def security_severity(severity: Column) -> Column:
    w = weight_of(severity)
    return F.when(w >= 40, "9.5").when(w >= 20, "8.0").when(w >= 10, "5.5").when(w >= 5, "3.0").otherwise("1.0")


def precision_of(confidence: Column) -> Column:
    return F.when(confidence == "proven", "very-high").when(confidence == "probable", "high").otherwise("medium")


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "proven", 3).when(confidence == "probable", 2).otherwise(1)


def normal_path(col: Column, root: str = "") -> Column:
    """Forward slashes, without the root, leading ./ and leading slash."""
    out = F.replace(col, F.lit("\\"), F.lit("/"))
    if root:
        out = F.regexp_replace(out, "^" + re.escape(root.rstrip("/") + "/"), "")
    return F.regexp_replace(F.regexp_replace(out, r"^(\./)+", ""), "^/+", "")


def line_content(text: Column, n: Column) -> Column:
    """Line n (from 1) with white space collapsed; null out of range."""
    lines = F.split(text, "\r\n|\r|\n", -1)
    line = F.when((n >= 1) & (n <= F.size(lines)), F.get(lines, n - 1))
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def line_at(text: Column, needle: Column) -> Column:
    """Line of the first occurrence of needle, 1 where there is none."""
    before = F.call_function("substring_index", text, needle, F.lit(1))
    found = F.contains(text, needle)
    return F.when(found, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(1)


def to_line(value: Column, last: Column | None = None) -> Column:
    """A line number from whatever was given: a number, its first digits, else 1; at least 1, at most last."""
    word = F.trim(value)
    number = F.coalesce(word.try_cast("long"), word.try_cast("double").try_cast("long"), F.regexp_extract(word, r"\d+", 0).try_cast("long"), F.lit(1).cast("long"))
    number = F.greatest(F.lit(1).cast("long"), number)
    return F.least(number, F.greatest(last.cast("long"), F.lit(1).cast("long"))) if last is not None else number


def to_bool(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def to_score(value: Column, penalty: Column) -> Column:
    """A given score cut to 0..100; without one, 100 less the penalty."""
    number = F.trim(value).try_cast("double")
    return F.when(number.isNull(), F.greatest(F.lit(0), 100 - penalty)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), number.cast("int")))).cast("int")


def clean_console(col: Column) -> Column:
    """Without escape sequences and control characters other than tab and newline."""
    return F.regexp_replace(F.regexp_replace(col, "\u001b\\[[0-9;]*[A-Za-z]", ""), "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")


def encode_path(col: Column) -> Column:
    """Percent-encode each segment of a path."""
    return F.array_join(F.transform(F.split(col, "/", -1), lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))), "/")


def shorten(col: Column, n: int) -> Column:
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n - 3)), F.lit("..."))).otherwise(col)


def studly(col: Column) -> Column:
    return F.replace(F.initcap(F.regexp_replace(col, "[-_]+", " ")), F.lit(" "), F.lit(""))


def short_name(col: Column) -> Column:
    return F.substring_index(col, "\\", -1)


def resource_parameter(uri: Column) -> Column:
    last = F.substring_index(F.regexp_replace(uri, "^/+|/+$", ""), "/", -1)
    return F.when(last.endswith("s") & (F.length(last) > 1), F.left(last, F.length(last) - 1)).otherwise(last)


def badge_colour(score: Column) -> Column:
    return F.when(score >= 80, "brightgreen").when(score >= 60, "yellow").when(score >= 40, "orange").otherwise("red")


def score_colour(score: Column, critical: Column) -> Column:
    red, orange = "#ef4444", "#f97316"
    return F.when(critical >= 3, red).when((critical >= 1) & (score < 50), red).when((critical >= 1) & (score < 70), orange).when(score < 40, red).when(score < 60, orange).when(score < 80, "#eab308").otherwise("#22c55e")


def join_prefix(*parts: Column) -> Column:
    """Route prefixes as one path; empty ones are skipped."""
    clean = [F.nullif(F.regexp_replace(p, "^/+|/+$", ""), F.lit("")) for p in parts]
    return F.concat(F.lit("/"), F.concat_ws("/", *clean))


#: Families of secrets and the mark that takes their place. Line breaks stay.
SECRETS = [
    ("__REDACTED_PRIVATE_KEY__", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"),
    ("__REDACTED_AWS_KEY__", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("__REDACTED_SECRET__", r"\b(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    ("__REDACTED_SECRET__", r"\bsk-[0-9A-Za-z_-]{20,}"),
    ("__REDACTED_SECRET__", r"\bgh[pousr]_[0-9A-Za-z]{30,}\b"),
    ("__REDACTED_SECRET__", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
]
ASSIGNED = r"""(?i)\b(password|passwd|secret|api_key|apikey|token|access_key)(["']?\s*(?:=>|=|:)\s*["']?)[^\s"',;]{6,}"""


def redact(col: Column) -> Column:
    """Secrets replaced by marks; a private key keeps its number of line breaks."""
    mark, key = SECRETS[0]
    blocks = F.regexp_extract_all(col, F.lit(f"({key})"), F.lit(1))
    out = F.aggregate(blocks, col, lambda text, block: F.replace(text, block, F.concat(F.lit(mark), F.regexp_replace(block, "[^\n]", ""))))
    for mark, pattern in SECRETS[1:]:
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(out, ASSIGNED, "$1$2__REDACTED_SECRET__")
