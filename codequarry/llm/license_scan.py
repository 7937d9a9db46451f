"""License scans by diagonal voting, in DataFrame operations only.

Every document is cut into words once, and the hash of each run of k words is
joined to the runs of the templates (broadcast: the templates are an argument,
at most MAX_TEMPLATE_RUNS runs). A match at word p of template word q votes for
the diagonal p - q. Votes are kept as a set of template runs, so a run that
neighbouring diagonals share counts once. A diagonal and its neighbours, at most slack words away
on either side, are merged, so a dropped or added word does not break a match,
and no chain of neighbours grows longer than that. A merged diagonal is verified
by the share of the template's runs that voted; of held neighbours the best is
reported. Only matches and a row a document are shuffled, never texts, and by a
number of the row, so no group is larger than the matches of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII characters that are in no word.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
MAX_TEMPLATE_RUNS = 20_000

#: Phrases of the base and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: The method's own templates.
TEMPLATES = [
    ("licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def words_of(text):
    """The words of a text, lower-cased in A-Z; what WORD finds."""
    return F.array_remove(F.split(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, k: int = 2, slack: int = 3, coverage: float = 0.7) -> DataFrame:
    """Find license phrases and near matches of license sentences.

    Returns a row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best coverage of a span that holds, else 0),
    and spans (label, first, end, coverage). Of neighbouring spans of equal
    coverage the first is reported. Words are lower-cased in A-Z only. Null text
    counts as empty: no words, empty labels, score 0. Repeated rows each get
    their result. Ids of any type come back as they are, null ids too. Bytes that
    are no valid UTF-8 are characters of words. Extra columns are ignored,
    whatever their names. An empty table gives an empty result. Templates have k
    words or more, MAX_TEMPLATE_RUNS runs together; a document of any length is one
    row of the scan, exploded as it is read, in time that is linear in its words.
    Runs of words are told apart by 64-bit hashes. Rows are told apart by their
    place in docs, which should be read from files (or written first, where its
    order is not fixed).
    """
    runs, meta = [], []
    for t, (phrase, label) in enumerate([*base, *templates]):
        words = phrase.split()
        if len(words) < k:
            raise ValueError(f"a template has at least {k} words: {phrase}")
        n = len(words) - k + 1
        meta.append((t, label, t < len(base), n))
        runs += [(*words[q : q + k], t, q) for q in range(n)]
    if len(runs) > MAX_TEMPLATE_RUNS:
        raise ValueError("too many template words; scan in several calls")
    spark = docs.sparkSession
    grams = spark.createDataFrame(runs, ", ".join(f"g{i} string" for i in range(k)) + ", t int, q int")
    grams = grams.select(F.xxhash64(*[f"g{i}" for i in range(k)]).alias("g"), "t", "q")
    about = spark.createDataFrame(meta, "t int, label string, is_base boolean, n int")

    # One scan: a row for each document (at place 0) and for each match.
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("d"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    n = F.size("w")
    if k == 1:
        hashes = F.transform("w", lambda x: F.xxhash64(x))
    else:
        at = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
        hashes = F.when(n < k, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)])))
    # Both are computed before rows are laid out: else the words themselves would go along with every row.
    about_text = words.select("row", "d", F.struct(n.cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("long")), hashes).alias("hashes")).alias("x"))
    places = about_text.select("row", "d", F.explode(F.array("x")).alias("x")).select("row", "d", F.col("x.n_words").alias("n_words"), F.posexplode("x.hashes").alias("p", "g"))
    found = places.join(F.broadcast(grams), "g", "left").where("p = 0 or t is not null").select("row", "d", "n_words", (F.col("p") - 1).alias("p"), "t", "q").repartition("row")

    vote = F.collect_set("q")
    first = [F.first("d").alias("d"), F.first("n_words").alias("n_words")]
    diagonals = found.groupBy("row", "t", (F.col("p") - F.col("q")).alias("diagonal")).agg(vote.alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"), *first)
    near = Window.partitionBy("row", "t").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = diagonals.join(F.broadcast(about), "t", "left").withColumn("exact", F.col("is_base") & (F.size("votes") == F.col("n")))
    merged = merged.withColumn("coverage", F.size(F.array_distinct(F.flatten(F.collect_list("votes").over(near)))) / F.col("n")).withColumn("first", F.min("low").over(near)).withColumn("end", F.max("high").over(near) + k)
    best = F.max(F.struct("coverage", (-F.col("diagonal")).alias("back"))).over(near)
    held = merged.withColumn("peak", (F.col("coverage") >= coverage) & (best["coverage"] == F.col("coverage")) & (best["back"] == -F.col("diagonal")))
    held = held.withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("peak", F.coalesce("peak", F.lit(False)))
    labels = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")
    return held.groupBy("row").agg(
        F.first("d").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("diagonal"))).cast("long").alias("last_word"),
        labels(F.col("exact")).alias("base_labels"),
        labels(F.col("exact") | F.col("peak")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("peak"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("peak"), F.struct("first", "end", "label", "coverage")))).alias("spans"),
    ).drop("row")


def op3_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    rows = [(t, label, int(t < len(BASE)), phrase.split()) for t, (phrase, label) in enumerate([*BASE, *TEMPLATES])]
    grams = ", ".join(f"('{w[q]}', '{w[q + 1]}', {t}, {q})" for t, _, _, w in rows for q in range(len(w) - 1))
    about = ", ".join(f"({t}, '{label}', {b}, {len(w) - 1}, CAST({(1 << (len(w) - 1)) - 1} AS BIGINT))" for t, label, b, w in rows)
    return rf"""
WITH grams(a, b, t, q) AS (VALUES {grams}), about(t, label, is_base, n, whole) AS (VALUES {about}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, p, ws[p + 1] AS a, ws[p + 2] AS b FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 1)) AS p FROM w)),
d AS (SELECT doc_id, t, p - q AS diagonal, bit_or(CAST(1 AS BIGINT) << q) AS votes FROM g JOIN grams USING (a, b) GROUP BY ALL),
m AS (SELECT *, is_base = 1 AND votes = whole AS exact, bit_count(bit_or(votes) OVER (PARTITION BY doc_id, t ORDER BY diagonal RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) / n AS coverage FROM d JOIN about USING (t)),
f AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(diagonal) FILTER (exact) AS first_word, max(diagonal) FILTER (exact) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact OR coverage >= 0.7) AS labels,
  max(coverage) FILTER (coverage >= 0.7) AS score FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN f ON w.doc_id = f.doc_id
"""


ORACLE = _oracle()
