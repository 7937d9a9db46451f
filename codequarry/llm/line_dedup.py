"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is its sequence of lines that are not blank. A run is MIN_LINES
lines, or one or two that hold MIN_WORDS words. Of the line hashes in each run
the smallest (the first of equals) is a fingerprint, so equal runs share one at
the same place, and one line is often the fingerprint of several runs. Places
whose fingerprint stands at other places too are joined and extended both ways,
through the hashes of the lines around them, to the runs that chose it. Of
equal runs the first by (doc_id, text hash, position) stays, and the lines of
later ones are deleted. Runs that overlap join, so any longer repeated run goes
as a whole.

Exchanges carry hashes and positions, plus the texts once. A line or passage
that stands everywhere is reduced by partial aggregation, and the joins back to
its places start from written tables, so that AQE can split a hot hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, kept, materialize, table

MIN_LINES, MIN_WORDS = 3, 50
WORD = r"[^\x20\x09-\x0D]+"


def _sizes(min_lines: int, min_words: int | None) -> list[int]:
    return [min_lines] if min_words is None else list(range(min_lines, 0, -1))


def _least(seq, start, size):
    """Index of the first smallest hash of the size lines of seq from start on."""
    a = [F.get(seq, start + i)["a"] for i in range(size)]
    out = F.when(F.lit(True), start + (size - 1)) if size == 1 else None
    for i in range(size - 1):
        smallest = a[i] <= F.least(*a[i + 1 :]) if size - i > 2 else a[i] <= a[i + 1]
        out = F.when(smallest, start + i) if out is None else out.when(smallest, start + i)
    return out if size == 1 else out.otherwise(start + (size - 1))


def _counts(seq, start, size, min_lines, min_words):
    """Whether the size lines of seq from start on are a run: inside it, and of enough lines or words."""
    inside = (start >= 0) & (start + size <= F.size(seq))
    if size == min_lines:
        return inside
    words = F.get(seq, start)["n"]
    for i in range(1, size):
        words = words + F.get(seq, start + i)["n"]
    return inside & (words >= min_words)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """Delete every run of min_lines or more lines, or of min_words or more words, that stands earlier in the table.

    With min_words None, runs count by their lines only.

    Returns a row per input row: doc_id, text (what is left), n_lines and
    n_removed. Lines end at \\n; blank lines (ASCII white space only) are no part
    of runs and stay. Words are runs without ASCII white space. Earlier means by
    doc_id (null first), then the text's hash, then position; so also earlier in
    the same document. Rows that repeat an id and its text count as one document
    and get the same result. A null text has no lines and stays null; an empty
    one is one blank line. Ids are cast to long (an id that is no integer fails).
    A text of any length is one row, as are the numbers of the lines that go from
    it. Lines are told apart by 128 bits of hashes. Bytes that are no valid UTF-8
    count as U+FFFD, and become that in what is left of a text that loses lines;
    a text that loses none comes back as it is. Columns named in keep come back as the struct kept; others are ignored,
    whatever their names. An empty table gives an empty result.
    """
    sizes = _sizes(min_lines, min_words)
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), kept(docs, keep).alias("kept")).withColumn("h", F.xxhash64("t"))
    n_words = (lambda x: F.lit(0)) if min_words is None else (lambda x: F.regexp_count(x, F.lit(WORD)))
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), n_words(x).alias("n"))
    full = F.filter(F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(WORD))
    lines = base.select("d", "h", F.transform(full, lambda s: line(s["x"], s["i"])).alias("s")).where(F.size("s") >= (min_lines if min_words is None else 1))
    lines = materialize(lines, "lines")
    n_docs = lines.count()

    # The fingerprints' places, each with the lines around it.
    starts = F.sequence(F.lit(0), F.size("s") - 1)
    fingerprints = lambda k: F.transform(F.filter(starts, lambda i: _counts(F.col("s"), i, k, min_lines, min_words)), lambda i: _least(F.col("s"), i, k))
    prints = lines.select("d", "h", "s", F.explode(F.array_distinct(F.concat(*map(fingerprints, sizes)))).alias("p"))
    reach = min_lines - 1
    first = F.greatest(F.col("p") - reach, F.lit(0))
    around = F.slice("s", first + 1, F.col("p") - first + 1 + reach)
    prints = prints.select("d", "h", F.get("s", F.col("p"))["a"].alias("f"), (F.col("p") - first).alias("c"), "p", around.alias("s"))
    place = F.struct("d", "h", "p")
    often = prints.groupBy("f").agg(F.min(place).alias("one"), F.max(place).alias("other")).where(~F.col("one").eqNullSafe(F.col("other"))).select("f")
    joined = prints.join(materialize(few(often, n_docs), "often"), "f")

    # Both ways from a fingerprint: the runs that chose it.
    def run(k, start):
        of = lambda part: [F.get("s", start + i)[part] for i in range(k)]
        found = F.struct(F.xxhash64(F.lit(k), *of("a")).alias("w1"), F.xxhash64(F.lit(-k), *of("b")).alias("w2"), F.array_compact(F.array(*of("i"))).alias("at"))
        return F.when(_counts(F.col("s"), start, k, min_lines, min_words) & (_least(F.col("s"), start, k) == F.col("c")), found)

    runs = [run(k, F.col("c") - back) for k in sizes for back in range(k)]
    extended = joined.select("d", "h", F.explode(F.array_compact(F.array(*runs))).alias("r")).select("d", "h", "r.*")
    extended = materialize(few(extended, n_docs), "extended")
    place = F.struct("d", "h", F.get("at", F.lit(0)).alias("i"))
    first = extended.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = extended.join(materialize(few(first, n_docs), "first"), ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("d", "h").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))
    whole = base.alias("l").join(gone.alias("r"), F.col("l.d").eqNullSafe(F.col("r.d")) & (F.col("l.h") == F.col("r.h")), "left")
    parts = F.split(F.col("l.t"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("l.t")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(F.col("l.t").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return whole.select(F.col("l.d").alias("doc_id"), text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"), *([F.col("l.kept")] if keep else []))


def op8_line_dedup(spark, sf_dir):
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS pos FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, len(regexp_extract_all(x, '{WORD}')) AS n FROM l WHERE regexp_matches(x, '{WORD}')),
o AS (SELECT doc_id, i, x, n, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(n, 1) OVER w AS n1 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, {MIN_LINES} AS k, concat(x, chr(10), x1, chr(10), x2) AS t FROM o WHERE x2 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, concat(x, chr(10), x1) FROM o WHERE n + n1 >= {MIN_WORDS} UNION ALL SELECT doc_id, i, 1, x FROM o WHERE n >= {MIN_WORDS}),
f AS (SELECT doc_id, i, k FROM (SELECT doc_id, i, k, row_number() OVER (PARTITION BY k, md5(t) ORDER BY doc_id, i) AS n FROM r) WHERE n > 1),
g AS (SELECT DISTINCT s.doc_id, s.pos FROM f JOIN s ON f.doc_id = s.doc_id AND s.i BETWEEN f.i AND f.i + f.k - 1),
k AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS t, count(*) AS n_lines, count(g.pos) AS n_removed FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
