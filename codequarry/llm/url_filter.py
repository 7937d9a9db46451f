"""URL filters: rules on host and path, and link-graph propagation for the rest.

Hosts are nodes. Links of pages to other hosts are edges, and so is each host's
place in the tree of names: a host and its parent (the name without its first
label, down to two labels) vouch for each other. Pages that a rule allows give
their host trust, pages that a rule blocks give it distrust. Trust is a
personalised PageRank along edges, distrust one against them (who links to
blocked hosts is suspect). A round is a join of the ranks with the written edges
and a sum by host. Each round leaves at most DAMPING of what was open before, so
the rounds that a given precision takes are known beforehand: they grow with the
logarithm of the pages, and none is left out. A host is blocked when its distrust
is at least FACTOR times its trust and at least LEAST of its pages' even share;
its pages without a rule get that verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.5  # of a rank goes on along edges, so a vouch halves at each
FACTOR, LEAST = 2.0, 0.01
PRECISION = 1e-3  # of the least distrust that can block
NODES_A_TASK = 500_000
LINK = r"(?i)\bhref\s*=\s*[\x22']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22'\s<>]+)"
MOST_RULES = 500  # of one expression; longer lists are joined as a table
VERDICT = "struct<verdict:string,rule:string>"


def host_of(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host, path, rules):
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(at + start).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast(VERDICT) if out is None else out


def matched_by_table(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, hit) of the distinct (host, path) of places that a rule of the table (verdict, host, path) fits; hit as of matched().

    Both conditions are met by equality: hosts bring their suffixes of whole
    labels, which meet rule hosts, and paths their prefixes of the lengths that
    such a host's rules have. So a host costs its labels, a path the distinct
    lengths of its hosts' rules, and no page meets the rules of a host one by one.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    order = F.struct(-F.length(F.concat("host", "path")), F.col("verdict"), F.col("host"), F.col("path"))
    value = F.struct(order.alias("order"), F.col("verdict"), F.concat("host", "path").alias("rule"))
    best = materialize(rules.groupBy(F.col("host").alias("at"), F.col("path").alias("start")).agg(F.min(value).alias("value")), "rules")
    lengths = best.groupBy("at").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = materialize(places.select("host", "path").distinct(), "places")
    ruled = distinct.select("host").distinct().select("host", F.explode(suffixes).alias("at")).join(lengths, "at")
    prefixes = distinct.join(ruled, "host").select("host", "path", "at", F.explode("lengths").alias("n")).where("n <= length(path)")
    met = prefixes.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(best, ["at", "start"])
    return met.groupBy("host", "path").agg(F.min("value").alias("_best")).select("host", "path", F.struct("_best.verdict", "_best.rule").alias("hit"))


def with_hits(pages: DataFrame, rules) -> DataFrame:
    """pages (host, path, ...) with hit, by one expression or, for tables and long lists, by joins."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            return pages.withColumn("hit", matched(F.col("host"), F.col("path"), rules))
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    return pages.join(matched_by_table(pages, rules), ["host", "path"], "left")


def name_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n) both ways between each host and its parent names of two labels or more; hosts that are numbers have none."""
    labels = F.split("host", r"\.")
    below = F.sequence(F.lit(1), F.size(labels) - 2)
    at = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    both = lambda i: F.array(F.struct(at(i).alias("src"), at(i + 1).alias("dst")), F.struct(at(i + 1).alias("src"), at(i).alias("dst")))
    named = hosts.where((F.size(labels) > 2) & ~F.col("host").rlike("^[0-9.]+(:[0-9]*)?$"))
    return named.select(F.explode(F.flatten(F.transform(below, both))).alias("e")).select("e.*").distinct().withColumn("n", F.lit(1).cast("long"))


def rounds_for(open_: float, damping: float = DAMPING) -> int:
    """Rounds after which at most open_ of all rank is not where it belongs."""
    return max(1, math.ceil(math.log(open_) / math.log(damping)))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, open_: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, n).

    Both ranks of all hosts sum to 1 (to 0 without seeds), and are right to
    open_. What hosts without edges hold goes back to the seeds: it leaks in the
    rounds and is made up for at the end, as it would have come back in the
    seeds' proportions. Hosts that are only linked to are nodes.
    """
    links = edges.where("src <> dst")
    ways = links.select(F.lit(0).alias("way"), "src", "dst", "n").union(links.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ways = materialize(ways, "ways")
    out = materialize(ways.groupBy("way", "src").agg(F.sum("n").alias("out")), "out")
    steps = materialize(ways.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("out")).alias("p")), "steps")
    total = seeds.agg(F.coalesce(F.sum("trust"), F.lit(0.0)), F.coalesce(F.sum("distrust"), F.lit(0.0))).first()
    seed = lambda way, c: F.struct(F.lit(way).alias("way"), F.col("host"), (F.col(c) / F.lit(total[way] or 1.0)).alias("seed"))
    start = seeds.select(F.explode(F.array(seed(0, "trust"), seed(1, "distrust"))).alias("x")).select("x.*").where("seed > 0")
    start = materialize(start.select("way", "host", (F.col("seed") * (1 - damping)).alias("rank")), "seeds")
    ranks = start
    n_tasks = max(1, -(-(out.count() + start.count()) // NODES_A_TASK))
    if not steps.isEmpty() and not start.isEmpty():
        for _ in range(rounds_for(open_ * (1 - damping), damping)):
            came = ranks.join(steps, (ranks.way == steps.way) & (ranks.host == steps.src)).select(steps.way, F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank"))
            ranks = materialize(start.union(came).groupBy("way", "host").agg(F.sum("rank").alias("rank")).coalesce(n_tasks), "ranks")
    has = {r["way"]: r["has"] for r in ranks.groupBy("way").agg(F.sum("rank").alias("has")).collect()}
    of = lambda way: F.sum(F.when(F.col("way") == way, F.col("rank") / F.lit(has.get(way, 1.0))).otherwise(0.0))
    nodes = seeds.select("host").union(links.select("src")).union(links.select("dst")).select(F.lit(2).alias("way"), "host", F.lit(0.0).alias("rank"))
    return ranks.union(nodes).groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, factor: float = FACTOR, least: float = LEAST) -> DataFrame:
    """Judge every page by the longest rule that fits, else by its host's ranks.

    Returns a row per input row: page_id, host, path, rule (null without one),
    verdict, trust, distrust. rules is a list of (verdict, host, path), or a table
    of them of any size, in which rows with nulls fit nothing and repeated rows
    are one. Of rules of equal length that fit, allow goes first, then the first
    by host and path. A null url, or one without ://, has
    empty host and path; such pages have no host node and are allowed. Null html
    has no links; links to //host count as links to that host, links without //
    stay on their host and are no edges. A page links to a host once, however
    often. Repeated rows count as pages of their own. Null ids are carried; ids
    of any type come back as they are. Html of any length is one row of the scan;
    bytes in it that are no valid UTF-8 count as U+FFFD. Extra columns are
    ignored, whatever their names. An empty table gives an empty result. A host's
    pages may be any share of all: host sums are partial sums, and the joins can
    be split.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = materialize(with_hits(base.select("page_id", "host", "path"), rules), "judged")
    judged = judged.select("page_id", "host", "path", "hit")
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = base.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = materialize(links, "links")
    verdict = F.col("hit.verdict")
    sums = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(verdict == "allow").cast("double").alias("trust"), F.count_if(verdict == "block").cast("double").alias("distrust"))
    sums = materialize(sums, "hosts")
    edges = links.union(name_edges(sums.select("host").union(links.select("dst")))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    everything = sums.agg(F.sum("pages")).first()[0] or 1
    ranks = propagate(sums.select("host", "trust", "distrust"), edges, open_=PRECISION * least / everything)
    share = F.col("pages") / F.lit(float(everything))
    bad = (F.col("distrust") >= factor * F.col("trust")) & (F.col("distrust") >= least * share)
    hosts = materialize(sums.select("host", "pages").join(ranks, "host").select("host", "trust", "distrust", bad.alias("bad")), "verdicts")
    said = F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), said.alias("verdict"), "trust", "distrust")


def op10_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages")).drop("trust", "distrust")


#: Rounds of the SQL: more than the query takes on any table that SQL is run on.
SQL_ROUNDS = 60


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {case([h + p for _, h, p in rules])} AS rule, {case([v for v, _, _ in rules])} AS said FROM u),
h AS (SELECT host, count(*) AS pages, CAST(count(*) FILTER (said = 'allow') AS DOUBLE) AS trust, CAST(count(*) FILTER (said = 'block') AS DOUBLE) AS distrust FROM j WHERE host <> '' GROUP BY host),
a AS (SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM u WHERE host <> ''),
l AS (SELECT src, dst, count(*) AS n FROM a WHERE dst <> src GROUP BY src, dst),
m AS (SELECT host, string_split(host, '.') AS x FROM (SELECT host FROM h UNION SELECT dst FROM l) WHERE NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$')),
o AS (SELECT DISTINCT array_to_string(x[i:], '.') AS child, array_to_string(x[i + 1:], '.') AS parent FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM m)),
e AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM l UNION ALL SELECT child, parent, 1 FROM o UNION ALL SELECT parent, child, 1 FROM o) GROUP BY src, dst),
w AS (SELECT 0 AS way, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
s AS (SELECT way, src, dst, n / sum(n) OVER (PARTITION BY way, src) AS p FROM w),
t AS (SELECT greatest(sum(trust), 1e-300) AS trust, greatest(sum(distrust), 1e-300) AS distrust FROM h),
z AS (SELECT way, host, max(seed) AS seed FROM (SELECT 0 AS way, host, h.trust / t.trust AS seed FROM h, t UNION ALL SELECT 1, host, h.distrust / t.distrust FROM h, t UNION ALL SELECT way, src, 0 FROM s UNION ALL SELECT way, dst, 0 FROM s) GROUP BY way, host),
b AS (SELECT z.way, z.host, z.seed, NOT EXISTS (SELECT 1 FROM s WHERE s.way = z.way AND s.src = z.host) AS dead FROM z),
f AS (SELECT way, host, dst, p FROM (SELECT b.way, b.host, s.dst, s.p FROM b JOIN s ON s.way = b.way AND s.src = b.host UNION ALL SELECT x.way, x.host, y.host, y.seed FROM b x JOIN b y ON x.way = y.way AND x.dead AND y.seed > 0)),
r(i, way, host, rank) AS (SELECT 0, way, host, seed FROM b UNION ALL
  SELECT i, way, host, sum(x) FROM (SELECT r.i + 1 AS i, r.way, f.dst AS host, {DAMPING} * r.rank * f.p AS x FROM r JOIN f ON f.way = r.way AND f.host = r.host UNION ALL SELECT r.i + 1, r.way, b.host, {1 - DAMPING} * b.seed FROM r JOIN b ON b.way = r.way AND b.host = r.host) WHERE i <= {SQL_ROUNDS} GROUP BY i, way, host),
d AS (SELECT h.host, max(r.rank) FILTER (r.way = 1) >= {FACTOR} * max(r.rank) FILTER (r.way = 0) AND max(r.rank) FILTER (r.way = 1) >= {LEAST} * any_value(h.pages) / (SELECT sum(pages) FROM h) AS bad FROM h JOIN r ON r.host = h.host AND r.i = {SQL_ROUNDS} GROUP BY h.host)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN d ON j.host = d.host
"""


ORACLE = _oracle()
