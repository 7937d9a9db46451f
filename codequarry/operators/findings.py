"""Findings: invariants, identity, dedupe and merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators.spans import file_key, lines_in_spans, path_suffixes, same_file, same_path, with_root
from codequarry.registry import CHEAT_SHEET_URL, CHEAT_SHEETS, CONFIDENCES, CWE_URL, SEVERITIES, TYPES, EngineConfig


def types_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TYPES)], "type_no int, type string, type_label string, owasp string, cwe string")


def severities_table(spark) -> DataFrame:
    return spark.createDataFrame(SEVERITIES, "severity string, weight int, severity_rank int, level string, security_severity string")


def confidences_table(spark) -> DataFrame:
    return spark.createDataFrame(CONFIDENCES, "confidence string, confidence_rank int, precision string")


def references_table(spark) -> DataFrame:
    sheets = {t: (title, CHEAT_SHEET_URL.format(slug)) for t, slug, title in CHEAT_SHEETS}
    rows = [(t[0], [r for r in ((t[3], CWE_URL.format(t[3].split("-")[1])), sheets.get(t[0])) if r]) for t in TYPES]
    return spark.createDataFrame(rows, "type string, references array<struct<title:string,url:string>>")


def normalise(findings: DataFrame) -> DataFrame:
    """The invariants: possible means review, and a review carries no fix."""
    class_ = F.when(F.col("confidence") == "possible", "review").otherwise(F.when(F.col("class") == "vulnerability", "vulnerability").otherwise("review"))
    return findings.withColumn("class", class_).withColumn("fix", F.when(F.col("class") == "review", "").otherwise(F.coalesce("fix", F.lit(""))))


def describe(findings: DataFrame) -> DataFrame:
    """With labels, weights and references; the dimension tables have tens of rows."""
    spark = findings.sparkSession
    out = findings
    for dim, on in ((types_table(spark), "type"), (severities_table(spark), "severity"), (confidences_table(spark), "confidence"), (references_table(spark), "type")):
        out = out.join(F.broadcast(dim), on, "left")
    return out


def identity_key(path="location", line="line", content=None):
    """type|path|src:<line's text>, or line:<number> where the text is not known."""
    place = F.concat(F.lit("line:"), F.col(line).cast("string"))
    if content is not None:
        text = T.line_content(content, F.col(line))
        place = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("src:"), text)).otherwise(place)
    return F.concat_ws("|", F.col("type"), T.normal_path(F.col(path)), place)


def fingerprint_of(key, occurrence, prefix: str = EngineConfig.fingerprint_prefix):
    """Half of the hash of a key and how many equal keys came before."""
    return F.left(F.sha2(F.concat(F.lit(prefix), key, F.lit("|"), occurrence.cast("string")), 256), F.lit(32))


def fingerprint(findings: DataFrame, scan=(), order=("ordinal",), key=None, prefix: str = EngineConfig.fingerprint_prefix) -> DataFrame:
    """With occurrence (0, 1, ... of equal keys of a scan in report order) and fingerprint.

    Compute it over the whole report, before any filter: subsets keep theirs.
    """
    key = identity_key() if key is None else key
    out = findings.withColumn("_key", key)
    along = Window.partitionBy(*scan, "_key").orderBy(*order)
    out = out.withColumn("occurrence", F.row_number().over(along) - 1)
    return out.withColumn("fingerprint", fingerprint_of(F.col("_key"), F.col("occurrence"), prefix)).drop("_key")


def token(type_=None):
    """What counts as one kind for merging: both access-control types are one."""
    t = F.col("type") if type_ is None else type_
    return F.when(t.isin("idor", "auth_bypass"), "access_control").otherwise(t)


def drop_exact(findings: DataFrame, scan=("scan_id",), order=("ordinal",)) -> DataFrame:
    """Of findings of one kind on one line the first stays."""
    along = Window.partitionBy(*scan, token(), "location", "line").orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(along)).where("_n = 1").drop("_n")


def line_clusters(rows: DataFrame, by, window: int) -> DataFrame:
    """Rows with _cluster: within a key, lines that follow one another by window or less are one cluster.

    A choice that looks window lines around never looks out of a cluster, so
    whatever the order of the choices, clusters are worked on apart.
    """
    along = Window.partitionBy(*by).orderBy("line")
    far = (F.col("line") - F.lag("line").over(along) > window).cast("long")
    return rows.withColumn("_cluster", F.sum(F.coalesce(far, F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def _first_of_near(window: int, by: tuple, columns: list[str], alike):
    """Of rows sorted by cluster and report order, those with no kept row of their cluster within window lines that alike(row, kept, same line) holds for."""

    def run(batches):
        at, kept = None, {}
        for b in batches:
            keep = []
            said = zip(*[b[c].to_pylist() for c in ("_path", "_proof", "_description")])
            for key, line, words in zip(zip(*[b[c].to_pylist() for c in by]), b["line"].to_pylist(), said):
                if key != at:
                    at, kept = key, {}
                near = (alike(words, x, n == line) for n in range(line - window, line + window + 1) for x in kept.get(n, ()))
                keep.append(not any(near))
                if keep[-1]:
                    kept.setdefault(line, []).append(words)
            yield b.select(columns).filter(pa.array(keep, pa.bool_()))

    return run


def _near_choice(findings: DataFrame, keys: tuple, location: str, window: int, alike) -> DataFrame:
    """Greedy choice in report order, by kind and file, in clusters of near lines; findings without a line all stay."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    ready = findings.where("line is not null").withColumns(
        {"_token": token(), "_path": file_key(F.col(location)), "_proof": squeezed("proof"), "_description": squeezed("description")}
    )
    ready = with_root(ready, (*keys, "_token"), "_path")
    by = (*keys, "_token", "_root")
    clusters = line_clusters(ready, by, window)
    by = (*by, "_cluster")
    ordered = clusters.repartition(*by).sortWithinPartitions(*by, F.col("ordinal").asc_nulls_last(), "line", "_path", "_proof", "_description")
    chosen = ordered.mapInArrow(_first_of_near(window, by, findings.columns, alike), findings.schema)
    return chosen.unionByName(findings.where("line is null"))


def drop_near(findings: DataFrame, scan=("scan_id",), window: int = 2) -> DataFrame:
    """Of findings of one kind in one file, the first of a line stays, and of those within window lines that say the same.

    Two say the same if their proofs or their descriptions are equal, but for
    case and white space, and not empty. Locations are one file if they are equal
    or one ends with the other (a bare name is any file of that name). Greedy in
    report order; a finding without a line stays. Clusters of near lines of one
    kind stream through tasks; of one, the lines kept so far are held.
    """
    same = lambda a, b, line: same_path(a[0], b[0]) and (line or (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2]))
    return _near_choice(findings, tuple(scan), "location", window, same)


def not_near(new: DataFrame, old: DataFrame, by=("scan_id", "location"), window: int = 5) -> DataFrame:
    """New findings with no old one of their kind within window lines of them in their file; the last of by is the location.

    Lines meet in stretches of window + 1: an old line is looked for in a new
    one's stretch and the two beside it, by equality, and paths meet the ends of
    longer ones by equality too, so neither a file with many findings nor a name
    that many folders have makes pairs of all. Findings without a line are near
    nothing.
    """
    *keys, location = by
    stretch = lambda line: F.floor(line / (window + 1)).cast("long")
    reach = F.explode(F.array(*[stretch(F.col("line")) + d for d in (-1, 0, 1)]))

    def points(df):
        return df.where("line is not null").select(*keys, token().alias("_token"), file_key(F.col(location)).alias("_path"), F.col("line").cast("long").alias("line")).distinct()

    o = points(old).withColumn("_at", reach).withColumnRenamed("line", "_line")
    n = points(new).withColumn("_at", stretch(F.col("line")))
    ends = F.explode(path_suffixes(F.col("_path")))

    def met(a, b):
        cond = F.abs(F.col("a.line") - F.col("b._line")) <= window
        for c in (*keys, "_token", "_at", "_met"):
            cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.alias("a").join(b.alias("b"), cond, "left_semi").select(*keys, "_token", "_path", "line")

    path = F.col("_path")
    hits = met(n.withColumn("_met", path), o.withColumn("_met", ends)).union(met(n.withColumn("_met", ends), o.withColumn("_met", path))).distinct()
    f = new.withColumns({"_token": token(), "_path": file_key(F.col(location))}).alias("f")
    cond = F.col("f.line") == F.col("h.line")
    for c in (*keys, "_token", "_path"):
        cond = cond & F.col(f"f.{c}").eqNullSafe(F.col(f"h.{c}"))
    return f.join(hits.alias("h"), cond, "left_anti").drop("_token", "_path")


def merge(new: DataFrame, old: DataFrame, by=("scan_id", "location"), window: int = 5) -> DataFrame:
    """Old findings, and the new ones away from old and from new ones taken before; in order, by file and kind.

    What counts as one file is as in drop_near; a new finding without a line is taken.
    """
    *keys, location = by
    same = lambda a, b, line: same_path(a[0], b[0])
    return old.unionByName(_near_choice(not_near(new, old, by, window), tuple(keys), location, window, same))


def outside_spans(findings: DataFrame, spans: DataFrame, by=("location",)) -> DataFrame:
    """Findings whose line is in no span (start, end) of their file; the last of by is the location.

    Locations are one file if they are equal or one ends with the other. A
    finding without a line is in no span.
    """
    *keys, location = by
    path = file_key(F.col(location)).alias("_path")
    lines = findings.where("line is not null").select(*keys, path, "line").distinct()
    around = spans.select(*keys, path, "start", "end").distinct()
    one_file = same_file(lines.select(F.col("_path").alias("id"), F.col("_path").alias("location")).distinct(), around.select(F.col("_path").alias("path")))
    asked = lines.join(one_file.withColumnRenamed("id", "_path"), "_path").withColumnRenamed("_path", "_asked")
    inside = lines_in_spans(asked, around.withColumnRenamed("_path", "path"), (*keys, "path")).select(*keys, "_asked", "line").distinct()
    f = findings.withColumn("_path", file_key(F.col(location))).alias("f")
    cond = (F.col("f._path") == F.col("i._asked")) & (F.col("f.line") == F.col("i.line"))
    for c in keys:
        cond = cond & F.col(f"f.{c}").eqNullSafe(F.col(f"i.{c}"))
    return f.join(inside.alias("i"), cond, "left_anti").drop("_path")


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings not in the baseline: by fingerprint, and by (file, type, hash) for entries that have none."""
    coded = baseline.where("fingerprint is not null and fingerprint <> ''").select("fingerprint").distinct()
    legacy = baseline.where("(fingerprint is null or fingerprint = '') and file is not null and type is not null and hash is not null").select(T.normal_path(F.col("file")).alias("_f"), F.col("type").alias("_t"), F.col("hash").alias("_h")).distinct()
    left = findings.join(coded, "fingerprint", "left_anti")
    return left.join(legacy, (T.normal_path(F.col("location")) == F.col("_f")) & (F.col("type") == F.col("_t")) & (F.md5(F.col("description").cast("binary")) == F.col("_h")), "left_anti")


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """(fingerprint, status): new, unchanged or resolved."""
    a, b = now.select("fingerprint").distinct().withColumn("_a", F.lit(1)), before.select("fingerprint").distinct().withColumn("_b", F.lit(1))
    return a.join(b, "fingerprint", "full").select("fingerprint", F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("unchanged").alias("status"))


def verify(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Critical and high findings that a verdict calls unverified drop one severity; verified ones keep theirs."""
    f = findings.join(verdicts.select("ordinal", "verified", "exploit"), "ordinal", "left")
    may = (F.col("class") == "vulnerability") & F.col("severity").isin("critical", "high")
    down = F.when(F.col("severity") == "critical", "high").otherwise("medium")
    dropped = may & (F.col("verified") == False)  # noqa: E712
    return (
        f.withColumn("original_severity", F.when(dropped, F.col("severity")).otherwise(F.col("original_severity")))
        .withColumn("exploit_verified", F.when(may, F.col("verified")).otherwise(F.col("exploit_verified")))
        .withColumn("exploit_proof", F.when(may, F.col("exploit")).otherwise(F.col("exploit_proof")))
        .withColumn("severity", F.when(dropped, down).otherwise(F.col("severity"))).drop("verified", "exploit")
    )


# --- scores -------------------------------------------------------------------


def confirmed():
    return F.col("class") == "vulnerability"


def scores(findings: DataFrame, by=("scan_id",)) -> DataFrame:
    """Score of each scan: 100 less the weights of its confirmed findings, at least 0."""
    weight = F.when(confirmed(), T.weight_of(F.col("severity"))).otherwise(0)
    return findings.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.sum(weight)).cast("int").alias("score"), F.count_if(confirmed()).alias("n_confirmed"), F.count_if(~confirmed()).alias("n_review"))


def score_breakdown(findings: DataFrame, scans: DataFrame, by="scan_id") -> DataFrame:
    """Every severity of every scan with count, weight and penalty, zeros included."""
    spark = findings.sparkSession
    counts = findings.where(confirmed()).groupBy(by, "severity").agg(F.count("*").alias("n"))
    grid = scans.select(by).distinct().select(by, F.explode(F.array(*[F.lit(s) for s, *_ in SEVERITIES])).alias("severity"))
    full = grid.join(counts, [by, "severity"], "left").join(F.broadcast(severities_table(spark).select("severity", "weight")), "severity")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return full.select(by, "severity", n.alias("n"), "weight", (n * F.col("weight")).alias("penalty"))


def fails_gate(findings: DataFrame, threshold: str, by=("scan_id",)) -> DataFrame:
    """Whether a scan has a confirmed finding of the threshold's weight; none never fails."""
    least = {s: w for s, w, *_ in SEVERITIES}.get(threshold)
    fails = F.lit(False) if least is None else F.coalesce(F.bool_or(confirmed() & (T.weight_of(F.col("severity")) >= least)), F.lit(False))
    return findings.groupBy(*by).agg(fails.alias("fails"))


def verifiable(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Confirmed critical and high findings, in files that this scan has read."""
    out = findings.where(confirmed() & F.col("severity").isin("critical", "high"))
    return out if files is None else out.join(files.select(T.normal_path(F.col("path")).alias("_p")).distinct(), T.normal_path(F.col("location")) == F.col("_p"), "left_semi")


def reclassify(findings: DataFrame, class_, confidence) -> DataFrame:
    """Another class and confidence, with the invariants applied again."""
    return normalise(findings.withColumn("class", class_).withColumn("confidence", confidence))


def may_fix():
    """Only a proven vulnerability may carry a fix, and not a blank one."""
    return confirmed() & (F.col("confidence") == "proven") & (F.trim("fix") != "")


def at_least(confidence, least: str):
    return T.confidence_rank(confidence) >= {c: r for c, r, _ in CONFIDENCES}[least]


def question(findings: DataFrame) -> DataFrame:
    """Review items phrased as a question, others as they are; 140 characters at most."""
    text = F.when(confirmed(), F.col("description")).otherwise(F.concat(F.lit("Is this intended: "), F.regexp_replace("description", r"\.+\s*$", ""), F.lit("?")))
    return findings.withColumn("phrase", T.shorten(text, 140))
