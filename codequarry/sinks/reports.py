"""Reports: JSON, SARIF, Markdown, HTML; and the tables scans leave behind.

A report is a table of lines: a head and a foot made from one row of counts, and
between them a piece for each finding, rendered by Spark expressions. In order of
`at` the lines are the document; save() writes them so, text() streams them. No
task and no driver holds a document.
"""

from __future__ import annotations

import datetime
import html
import json
import secrets
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import registry as R
from codequarry.operators.lineage import checkpointed
from codequarry.schemas import SAVED_FINDING, USAGE
from codequarry.sources import documents

_RANK = {s: r for s, _, r, *_ in R.SEVERITIES}
_REASON = R.SKIP_REASONS
FINDING = SAVED_FINDING
FIELDS = [f.split()[0] for f in FINDING.split(", ")]


def chosen(col, values: dict, otherwise=None):
    """The value of a small fixed table at col."""
    out = None
    for k, v in values.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(F.lit(otherwise))


def summary(findings: DataFrame, coverage: dict | None = None, text: str = "", target_error: str | None = None) -> dict:
    """Counts, score and what withholds it: all of a report but its findings, from one row of sums."""
    sure = F.col("class") == "vulnerability"
    row = findings.agg(*[F.count_if(sure & (F.col("severity") == s)).alias(s) for s in _RANK], F.count_if(sure).alias("total"), F.count_if(~sure).alias("review")).first()
    counts = row.asDict()
    severities = [{"severity": s, "count": counts[s], "weight": w, "penalty": counts[s] * w} for s, w, *_ in R.SEVERITIES]
    penalty = sum(s["penalty"] for s in severities)
    why = target_error or ("coverage is incomplete" if coverage and not coverage.get("complete", True) else None)
    return {
        "overall_score": None if why else max(0, 100 - penalty),
        "score_suppressed": bool(why),
        "score_suppression_reason": why,
        "target_error": target_error,
        "summary": text,
        "counts": counts,
        "score_breakdown": {"formula": "max(0, 100 - sum(count * weight))", "base": 100, "severities": severities, "total_penalty": penalty, "score": max(0, 100 - penalty)},
        "coverage": coverage,
    }


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with all columns a report needs and their place: worst first, then file, line, type."""
    missing = [F.lit(None).cast("string").alias(c) for c in FIELDS if c not in findings.columns]
    rows = findings.select(*[c for c in FIELDS if c in findings.columns], *missing)
    place = [-chosen(F.col("severity"), _RANK, 0), F.coalesce("location", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("type", F.lit("")), F.xxhash64("description", "proof", "fix")]
    place = [c.alias(f"k{n}") for n, c in enumerate(place)]
    keyed = rows.select("*", F.struct(F.lit(1).alias("part"), *place).alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))  # equal findings only
    return keyed.withColumn("at", F.struct("key.*", nth.alias("nth"))).drop("key")


def _lines(rows: DataFrame, piece, head: str, foot: str, joined: bool) -> DataFrame:
    """(at, text): head, a piece a finding (with commas between them if joined), foot."""
    if joined:
        first = rows.agg(F.min("at").alias("first"))
        rows = rows.join(F.broadcast(first))  # one row
        piece = F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), piece)
    body = rows.select("at", piece.alias("text"))
    ends = rows.sparkSession.createDataFrame([(0, head), (2, foot)], "part int, text string")
    blank = F.struct("part", *[F.lit(None).cast(f.dataType).alias(f.name) for f in body.schema["at"].dataType.fields[1:]])
    return body.union(ends.select(blank.alias("at"), "text"))


def json_lines(findings: DataFrame, report: dict) -> DataFrame:
    labels = {t[0]: t for t in R.TYPES}
    about = [chosen(F.col("type"), {k: t[n] for k, t in labels.items()}).alias(name) for n, name in ((1, "type_label"), (2, "owasp"), (3, "cwe"))]
    head = json.dumps(report, ensure_ascii=False, default=str)[:-1] + ', "vulnerabilities": ['
    return _lines(ordered(findings), F.to_json(F.struct(*FIELDS, *about)), head, "]}", True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved report; missing keys take defaults, a missing class means vulnerability.

    A report that json_lines laid out is read piece by piece; any other is parsed
    as one JSON document a file, and one that does not parse is an error.
    """
    lines = spark.read.text(path)
    if not lines.where("value rlike '^[{].*\"vulnerabilities\": \\\\[$'").isEmpty():
        piece = F.from_json(F.regexp_replace("value", "^,", ""), FINDING)
        v = lines.where("value rlike '^,?[{]\"(type|location|line|severity|description)\"'").select(piece.alias("v")).select("v.*")
    else:
        whole = F.from_json("value", f"struct<vulnerabilities:array<struct<{FINDING}>>>")["vulnerabilities"]
        no_report = F.raise_error(F.lit("not a saved report: no JSON document with vulnerabilities")).cast(f"array<struct<{FINDING}>>")
        documents = spark.read.text(path, wholetext=True).where("trim(value) <> ''")
        v = documents.select(F.explode(F.coalesce(whole, no_report)).alias("v")).select("v.*")
    sure = F.coalesce("confidence", F.lit("probable"))
    review = (sure == "possible") | (F.coalesce("class", F.lit("vulnerability")) == "review")
    known = F.coalesce(F.col("type").isin([t[0] for t in R.TYPES]), F.lit(False))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return v.select(
        F.when(known, F.col("type")).otherwise(R.DEFAULT_TYPE).alias("type"), text("location"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("severity", F.lit("low")).alias("severity"),
        text("description"), text("proof"), F.when(review, "").otherwise(F.coalesce("fix", F.lit(""))).alias("fix"),
        F.when(review, "review").otherwise("vulnerability").alias("class"), sure.alias("confidence"), "fingerprint",
    )


def uri(path):
    """A path with its segments percent-encoded."""
    one = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.split(path, "/", -1), one), "/")


def sarif_lines(findings: DataFrame, skipped: DataFrame | None = None, tool: str = "codequarry", version: str = "1.0") -> DataFrame:
    """SARIF 2.1.0: rules by type (in order of their worst finding), results, and a notification for each skipped file (path, reason)."""
    rows = ordered(findings)
    labels = {t[0]: t for t in R.TYPES}
    level = {s: level for s, _, _, level, _ in R.SEVERITIES}
    score = {s: score for s, _, _, _, score in R.SEVERITIES}
    sure = F.col("class") == "vulnerability"
    # One row a type: bounded by the types there are.
    kinds = rows.groupBy("type").agg(F.min("at").alias("at"), F.max_by(F.when(sure, F.col("severity")), F.when(sure, chosen(F.col("severity"), _RANK, 0)).otherwise(-1)).alias("worst")).orderBy("at").collect()
    rules = []
    for k in kinds:
        t = labels.get(k["type"], (k["type"], k["type"], "", ""))
        props = {"tags": ["security", *([f"external/cwe/{t[3].lower()}"] if t[3] else [])]}
        if k["worst"]:
            props["security-severity"] = score[k["worst"]]
        rules.append({"id": t[0], "name": t[1], "shortDescription": {"text": t[1]}, "properties": props})
    index = chosen(F.col("type"), {r["id"]: n for n, r in enumerate(rules)} or {"": 0})
    shown = F.when(F.coalesce("description", F.lit("")) == "", chosen(F.col("type"), {k: t[1] for k, t in labels.items()}, "")).otherwise(F.col("description"))
    place = F.struct(F.struct(uri(F.col("location")).alias("uri"), F.lit("SRCROOT").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine")).alias("region"))
    result = F.struct(
        F.col("type").alias("ruleId"),
        index.alias("ruleIndex"),
        F.when(sure, chosen(F.col("severity"), level, "note")).otherwise("note").alias("level"),
        F.struct(shown.alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct("class", chosen(F.col("confidence"), {c: p for c, _, p in R.CONFIDENCES}, "medium").alias("precision")).alias("properties"),
        F.when(F.col("fingerprint").isNotNull(), F.struct(F.col("fingerprint").alias("finding/v1"))).alias("partialFingerprints"),
    )
    driver = json.dumps({"name": tool, "version": version, "rules": rules})
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + driver + '}, "results": ['
    foot = '], "invocations": [{"executionSuccessful": true, "toolExecutionNotifications": ['
    out = _lines(rows, F.to_json(result), head, foot, True)
    # Notifications follow the foot, in order of path; the last line closes.
    notes = skipped.select("path", "reason").distinct() if skipped is not None else findings.sparkSession.createDataFrame([], "path string, reason string")
    note = F.struct(F.lit("warning").alias("level"), F.struct(F.concat("path", F.lit(": "), F.coalesce(chosen(F.col("reason"), _REASON), F.col("reason"))).alias("text")).alias("message"))
    notes = notes.join(F.broadcast(notes.agg(F.min(F.struct("path", "reason")).alias("first"))))  # one row
    comma = F.when(F.struct("path", "reason") == F.col("first"), "").otherwise(",")
    fields = out.schema["at"].dataType.fields
    at = lambda part, path: F.struct(*[part.alias(f.name) if f.name == "part" else path.alias(f.name) if f.name == "k1" else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    close = findings.sparkSession.createDataFrame([("]}]}]}",)], "text string")
    out = out.union(notes.select(at(F.lit(3), F.col("path")).alias("at"), F.concat(comma, F.to_json(note)).alias("text")))
    return out.union(close.select(at(F.lit(4), F.lit(None).cast("string")).alias("at"), "text"))


def md_escape(text):
    return F.replace(F.regexp_replace(text, r"([\\`*_{}\[\]<>#|])", r"\\$1"), F.lit("\n"), F.lit(" "))


def md_fence(code):
    """A block whose fence is longer than any run of backticks inside."""
    longest = F.array_max(F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), lambda x: F.length(x)))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))
    return F.concat(mark, F.lit("\n"), code, F.lit("\n"), mark)


def type_label():
    return F.coalesce(chosen(F.col("type"), {t[0]: t[1] for t in R.TYPES}), F.col("type"))


def markdown_lines(findings: DataFrame, report: dict) -> DataFrame:
    score = f"withheld ({report['score_suppression_reason']})" if report["score_suppressed"] else report["overall_score"]
    head = ["# Security report", "", f"Score: {score}", "", "| Severity | Count |", "| --- | --- |", *[f"| {s} | {report['counts'][s]} |" for s in _RANK]]
    block = lambda name: F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"\n\n{name.capitalize()}:\n\n"), md_fence(F.col(name)))).otherwise("")
    title = F.concat(F.lit("\n## "), md_escape(type_label()), F.lit(" ("), "severity", F.lit(", "), "class", F.lit(")\n\n"))
    place = F.concat(md_escape(F.coalesce("location", F.lit(""))), F.lit(":"), F.col("line").cast("string"), F.lit("\n\n"))
    return _lines(ordered(findings), F.concat(title, place, md_escape(F.coalesce("description", F.lit(""))), block("proof"), block("fix")), "\n".join(head), "", False)


def html_escape(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def colour(score: int | None, critical: int) -> str:
    if score is None:
        return "#6b7280"
    if critical >= 3 or (critical and score < 50) or score < 40:
        return "#ef4444"
    return "#f97316" if (critical and score < 70) or score < 60 else "#eab308" if score < 80 else "#22c55e"


def html_lines(findings: DataFrame, report: dict) -> DataFrame:
    score = report["overall_score"]
    shown = html.escape("withheld" if score is None else str(score))
    head = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Security report</title></head><body>'
    head += f'<h1 style="color:{colour(score, report["counts"]["critical"])}">{shown}</h1><table><tr><th>Severity</th><th>Type</th><th>Place</th><th>Description</th></tr>'
    place = F.concat(F.coalesce("location", F.lit("")), F.lit(":"), F.col("line").cast("string"))
    cells = [F.concat(F.lit("<td>"), html_escape(c), F.lit("</td>")) for c in (F.col("severity"), type_label(), place, F.coalesce("description", F.lit("")))]
    return _lines(ordered(findings), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")), head, "</table></body></html>", False)


def lines(findings: DataFrame, kind: str, report: dict) -> DataFrame:
    if kind == "sarif":
        return sarif_lines(findings)
    return {"json": json_lines, "markdown": markdown_lines, "html": html_lines}[kind](findings, report)


def text(found: DataFrame) -> Iterator[str]:
    """The lines of a document in order, a partition at a time."""
    return (r["text"] for r in found.orderBy("at").toLocalIterator())


def save(found: DataFrame, path: str) -> None:
    """The document as text files; in order of their names they are its lines."""
    found.orderBy("at").select("text").write.mode("overwrite").text(path)


def badge(score: int) -> str:
    return "brightgreen" if score >= 80 else "yellow" if score >= 60 else "orange" if score >= 40 else "red"


def share_text(report: dict) -> str:
    c = report["counts"]
    return f"Score {report['overall_score']}/100: {c['critical']} critical, {c['high']} high, {c['medium']} medium, {c['low']} low."


def scan_id() -> str:
    """A sortable id: milliseconds, then randomness, in Crockford's base 32."""
    n = (int(time.time() * 1000) << 80) | secrets.randbits(80)
    return "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[n >> 5 * i & 31] for i in range(25, -1, -1))


def save_history(findings: DataFrame, path: str, report: dict, **about) -> str:
    """Append one scan: its head as a row of path/scans, its findings as rows of path/findings; its id."""
    id_ = scan_id()
    made = {"id": id_, "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    spark = findings.sparkSession
    head = spark.createDataFrame([(json.dumps(report | about | made, default=str),)], "value string")
    head.write.mode("append").text(f"{path}/scans")
    ordered(findings).select(F.lit(id_).alias("id"), *FIELDS).write.mode("append").json(f"{path}/findings")
    return id_


def delete_history(spark: SparkSession, path: str, ids: list[str] | None = None) -> int:
    """Delete scans of a saved history, all of them without ids; how many there were.

    Deletions are rows of path/deleted, so a reader at work sees one state or the
    other, and deleting again changes nothing. Readers leave deleted scans out.
    """
    there = documents.kept_scans(spark, path).select("id").distinct()
    going = there if ids is None else there.where(F.col("id").isin(list(ids)))
    going = checkpointed(going)
    n = going.count()
    if n:
        going.write.mode("append").json(f"{path}/deleted")
    return n


def headline(findings: DataFrame) -> DataFrame:
    """The first finding of a report: the worst one."""
    return ordered(findings).orderBy("at").limit(1).select(*FIELDS)


def append_usage(rows: DataFrame, path: str) -> None:
    """Append usage rows; every append is a file of its own, so a broken one harms no other."""
    rows.write.mode("append").json(path)


def set_aside(spark: SparkSession, path: str, aside: str) -> int:
    """Keep what of a usage log cannot be read as rows (file, value) of another table, each once; how many are new."""
    bad = documents.rejects(spark, path, USAGE).distinct()
    known = documents.set_aside_rows(spark, aside)
    new = checkpointed(bad.join(known, ["file", "value"], "left_anti"))
    n = new.count()
    if n:
        new.write.mode("append").json(aside)
    return n


def write_baseline(findings: DataFrame, path: str) -> None:
    """All findings of both classes, fingerprinted beforehand."""
    findings.select("fingerprint", F.col("location").alias("file"), "line", "type", F.md5(F.col("description").cast("binary")).alias("hash")).write.mode("overwrite").json(path)
