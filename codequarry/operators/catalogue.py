"""Joins over the code catalogue: as-of, closures, routes, policies, locations, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.lineage import checkpointed
from codequarry.operators.spans import names_around, path_suffixes, same_file
from codequarry.registry import RESOURCE_ROUTES


def latest_before(uses: DataFrame, facts: DataFrame, by: tuple, at: str, value: str) -> DataFrame:
    """Each use with the value of the latest fact at or before it, in one pass over both.

    Facts and uses are laid into one sequence and the last fact is carried
    forward, so no pair of a key is ever built. Of facts at one place the
    largest value counts.
    """
    f = facts.groupBy(*by, at).agg(F.max(value).alias("_v")).select(*by, at, F.lit(0).alias("_use"), "_v", F.lit(None).cast("long").alias("_row"))
    rows = uses.withColumn("_row", F.monotonically_increasing_id())
    u = rows.select(*by, at, F.lit(1).alias("_use"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"), "_row")
    carried = f.unionByName(u).withColumn("_v", F.last("_v", True).over(Window.partitionBy(*by).orderBy(at, "_use").rowsBetween(Window.unboundedPreceding, 0)))
    return carried.where("_use = 1").select(*by, at, F.col("_v").alias(value))


def ancestors(parents: DataFrame) -> DataFrame:
    """(child, ancestor, depth) over (child, parent); a cycle is cut where it comes back.

    Each round joins the frontier to the parents, which are one row a class,
    and is checkpointed, so a round is computed once; rounds go on until the
    frontier is empty, however deep the classes are.
    """
    step = checkpointed(parents.select("child", F.col("parent").alias("ancestor")).where("parent is not null and child <> parent").distinct())
    edges = step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"))
    out = step.withColumn("depth", F.lit(1)).withColumn("seen", F.array("child", "ancestor"))
    all_, depth = out.drop("seen"), 1
    while not out.isEmpty():
        depth += 1
        new = out.join(edges, "ancestor").where(~F.array_contains("seen", F.col("next")))
        out = checkpointed(new.select("child", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("seen", F.array("next")).alias("seen")))
        all_ = all_.unionByName(out.drop("seen"))
    return all_.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


#: Where a model can declare a column redacted, as the source writes it, in order: heading, form, site.
REDACTION_SITES = [("hidden", "property", "$hidden"), ("hidden", "attribute", "#[Hidden]"), ("guarded", "property", "$guarded"), ("guarded", "attribute", "#[Guarded]")]


def redactions(asked: DataFrame, declarations: DataFrame, parents: DataFrame) -> DataFrame:
    """asked (model, attribute) with sites: where the model or an ancestor of it declares the attribute redacted, nearest first, each once.

    declarations: (class, heading, form, names), the string literals of a class's
    own arrays; parents: (child, parent). Declarations of all ancestors count, not
    only of the nearest, and names are compared without case. Only ancestors of
    classes that are asked for are met with declarations, by (class, name).
    """
    site = F.coalesce(*[F.when((F.col("heading") == h) & (F.col("form") == f), F.struct(F.lit(n).alias("n"), F.lit(s).alias("site"))) for n, (h, f, s) in enumerate(REDACTION_SITES)])
    named = declarations.select(F.col("class").alias("ancestor"), site.alias("at"), F.explode("names").alias("name")).where("at is not null")
    named = named.select("ancestor", "at", F.lower("name").alias("_name")).distinct()
    asks = asked.select("model", "attribute", F.lower("attribute").alias("_name")).distinct()
    models = asks.select("model").distinct()
    family = ancestors(parents).join(models, F.col("child") == F.col("model"), "left_semi").select(F.col("child").alias("model"), "ancestor", "depth")
    family = family.union(models.select("model", F.col("model").alias("ancestor"), F.lit(0).alias("depth")))
    met = asks.join(family, "model").join(named, ["ancestor", "_name"]).groupBy("model", "attribute", "at").agg(F.min("depth").alias("depth"))
    sites = F.transform(F.array_sort(F.collect_list(F.struct("depth", "at"))), lambda x: x["at"]["site"])
    found = met.groupBy("model", "attribute").agg(sites.alias("sites"))
    return asked.join(found, ["model", "attribute"], "left").withColumn("sites", F.coalesce("sites", F.array().cast("array<string>")))


def closure_sql(name: str = "parents", most: int = 32) -> str:
    """The same closure as one recursive query."""
    return f"""
WITH RECURSIVE up(child, ancestor, depth) AS (
  SELECT child, parent, 1 FROM {name} WHERE parent IS NOT NULL AND parent <> child
  UNION ALL SELECT up.child, p.parent, up.depth + 1 FROM up JOIN {name} p ON p.child = up.ancestor WHERE p.parent IS NOT NULL AND p.parent <> p.child AND p.parent <> up.child AND up.depth < {most})
SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor"""


def unique_names(classes: DataFrame) -> DataFrame:
    """(short, fqcn) of short names that only one class has."""
    return classes.select(F.substring_index("fqcn", "\\", -1).alias("short"), "fqcn").distinct().groupBy("short").agg(F.count("*").alias("n"), F.first("fqcn").alias("fqcn")).where("n = 1").drop("n")


def first_route(actions: DataFrame, routes: DataFrame) -> DataFrame:
    """Actions (class, method) with the first route of their short class and method."""
    short = F.lower(F.substring_index(F.substring_index("action", "@", 1), "\\", -1))
    best = routes.withColumn("_c", short).withColumn("_m", F.lower(F.substring_index("action", "@", -1))).withColumn("_n", F.row_number().over(Window.partitionBy("_c", "_m").orderBy("ordinal"))).where("_n = 1")
    keyed = actions.withColumn("_c", F.lower(F.substring_index("class", "\\", -1))).withColumn("_m", F.lower("method"))
    return keyed.join(best.select("_c", "_m", "verb", "uri", "middleware"), ["_c", "_m"], "left").drop("_c", "_m")


def unrouted(actions: DataFrame, routes: DataFrame) -> DataFrame:
    """Actions that no route names."""
    known = routes.select(F.lower(F.substring_index(F.substring_index("action", "@", 1), "\\", -1)).alias("_c"), F.lower(F.substring_index("action", "@", -1)).alias("_m")).distinct()
    return actions.join(known, (F.lower(F.substring_index("class", "\\", -1)) == F.col("_c")) & (F.lower("method") == F.col("_m")), "left_anti")


def merge_verbs(routes: DataFrame) -> DataFrame:
    """One row an action and uri, verbs joined by |, HEAD dropped."""
    return routes.where("verb <> 'HEAD'").groupBy("action", "uri").agg(F.array_join(F.array_sort(F.collect_set("verb")), "|").alias("verbs"))


def expand_resources(resources: DataFrame) -> DataFrame:
    """(uri, api, only, except) -> one row a route: method, verb, full uri."""
    p = F.regexp_replace(F.substring_index(F.regexp_replace("uri", "^/+|/+$", ""), "/", -1), "(?<=.)s$", "")
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(m).alias("method"), F.lit(v).alias("verb"), F.lit(t).alias("tail")) for i, (m, v, t) in enumerate(RESOURCE_ROUTES)])
    kept = F.filter(rows, lambda r: (~F.col("api") | ~r["method"].isin("create", "edit")) & (F.col("only").isNull() | F.array_contains("only", r["method"])) & (F.col("except").isNull() | ~F.array_contains("except", r["method"])))
    base = F.concat(F.lit("/"), F.regexp_replace("uri", "^/+", ""))
    return resources.withColumn("r", F.explode(kept)).select("uri", F.col("r.method").alias("method"), F.col("r.verb").alias("verb"), F.concat(base, F.replace(F.col("r.tail"), F.lit("{p}"), F.concat(F.lit("{"), p, F.lit("}")))).alias("full_uri"))


def inherited_middleware(routes: DataFrame, groups: DataFrame) -> DataFrame:
    """Routes (file, position) with the middleware of the groups around them, outermost first, each once."""
    return names_around(routes, groups)


def vote(votes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key, the first seen among equals."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "_first"))).where("_n = 1").select(key, value, "votes")


def locate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings (id, location) with the corpus path they mean: equal or a suffix of each other, longest first."""
    best = same_file(findings, files).groupBy("id").agg(F.min_by("path", F.struct(-F.length("path"), "path")).alias("path"))
    return findings.join(best, "id", "left")


def changed(head: DataFrame, base: DataFrame) -> DataFrame:
    """Files of head that are new or differ in content from base."""
    sign = lambda df: df.select("path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"))
    return sign(head).join(sign(base), ["path", "hash"], "left_anti").select("path")


# --- sets of request fields ---------------------------------------------------
# A reach is struct(kind, fields): all, only these, or all except these.


def reach_only(reach, fields):
    kept = F.when(reach["kind"] == "only", F.array_intersect(fields, reach["fields"])).when(reach["kind"] == "except", F.array_except(fields, reach["fields"])).otherwise(fields)
    return F.struct(F.lit("only").alias("kind"), kept.alias("fields"))


def reach_except(reach, fields):
    kind = F.when(reach["kind"] == "only", "only").when(F.size(fields) == 0, reach["kind"]).otherwise("except")
    kept = F.when(F.size(fields) == 0, reach["fields"]).when(reach["kind"] == "only", F.array_except(reach["fields"], fields)).otherwise(F.array_union(reach["fields"], fields))
    return F.struct(kind.alias("kind"), kept.alias("fields"))


def reaches(reach, field):
    return F.when(reach["kind"] == "only", F.array_contains(reach["fields"], field)).when(reach["kind"] == "except", ~F.array_contains(reach["fields"], field)).otherwise(True)


def combine_taint(judgements: DataFrame, by: tuple) -> DataFrame:
    """Worst judgement of a key: full taint, then path taint, unknown, trusted; nothing is unknown."""
    rank = F.when(F.col("trust") == "tainted", F.when(F.col("reach") == "full", 3).otherwise(2)).when(F.col("trust") == "trusted", 0).otherwise(1)
    worst = F.coalesce(F.max(rank), F.lit(1))
    names = F.when(worst == 3, "tainted").when(worst == 2, "tainted_path").when(worst == 1, "unknown").otherwise("trusted")
    return judgements.groupBy(*by).agg(names.alias("judgement"))


# --- names, policies, kinds -----------------------------------------------------


def resolve_location(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings (id, location) with the file they mean: the path itself, else the one path that ends with it, else the one file of that name or stem.

    A step counts only where it finds exactly one file. Files are counted by
    path ending and by stem first, so a name that many folders have is one row
    and makes no pairs.
    """
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    c = files.select("path").distinct()
    found = findings.select("id", "location").distinct()
    exact = found.join(c, F.col("location") == F.col("path")).select("id", F.lit(1).alias("step"), F.lit(1).cast("long").alias("n"), "path")
    # Paths that the location ends with are at most as many as it has segments; those that end with it are counted by ending.
    longer = found.select("id", "location", F.explode(path_suffixes(F.col("location"))).alias("path")).where("path <> location").join(c, "path")
    longer = longer.select("id", F.lit(2).alias("step"), F.lit(1).cast("long").alias("n"), "path")
    ends = c.select("path", F.explode(path_suffixes(F.col("path"))).alias("location")).where("path <> location")
    ends = ends.groupBy("location").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    shorter = found.join(ends, "location").select("id", F.lit(2).alias("step"), "n", "path")
    stems = c.groupBy(stem(F.col("path")).alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    base = found.withColumn("stem", stem(F.col("location"))).join(stems, "stem").select("id", F.lit(3).alias("step"), "n", "path")
    only = exact.union(longer).union(shorter).union(base).groupBy("id", "step").agg(F.sum("n").alias("n"), F.min("path").alias("path")).where("n = 1")
    best = only.groupBy("id").agg(F.min_by("path", "step").alias("path"))
    return findings.join(best, "id", "left")


def policy_models(policies: DataFrame, explicit: DataFrame, models: DataFrame, imports: DataFrame) -> DataFrame:
    """(policy, model): the explicit map, else the model named like the policy, else the one model it imports."""
    named = F.regexp_replace(F.substring_index("policy", "\\", -1), "Policy$", "")
    m = models.select("model", F.substring_index("model", "\\", -1).alias("_short")).groupBy("_short").agg(F.min("model").alias("_named"))
    i = imports.join(models, "model").groupBy("policy").agg(F.count_distinct("model").alias("_n"), F.min("model").alias("_imported")).where("_n = 1")
    e = explicit.groupBy("policy").agg(F.min("model").alias("_explicit"))
    out = policies.join(e, "policy", "left").withColumn("_short", named).join(m, "_short", "left").join(i, "policy", "left")
    return out.select("policy", F.coalesce("_explicit", "_named", "_imported").alias("model"))


#: Public methods of policies that are no abilities.
HELPERS = ["__construct", "before", "after", "allow", "deny", "denywithstatus", "denyasnotfound"]


def abilities(methods: DataFrame) -> DataFrame:
    """(class, abilities) of policy classes: their public methods less the helpers, sorted."""
    ok = methods.where((F.col("visibility") == "public") & ~F.lower("method").isin(HELPERS))
    return ok.groupBy("class").agg(F.array_sort(F.collect_set("method")).alias("abilities"))


def has_ability(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """asked (model, ability) with declared true or false; names meet by short name and without case."""
    d = declared.select(F.lower(F.substring_index("model", "\\", -1)).alias("_m"), F.explode("abilities").alias("_a")).select("_m", F.lower("_a").alias("_a")).distinct().withColumn("_yes", F.lit(True))
    a = asked.withColumn("_m", F.lower(F.substring_index("model", "\\", -1))).withColumn("_a", F.lower("ability"))
    return a.join(d, ["_m", "_a"], "left").select("model", "ability", F.coalesce("_yes", F.lit(False)).alias("declared"))


def descends(closure: DataFrame, bases) -> DataFrame:
    """Children with one of the bases, or its short name, above them."""
    return closure.where(F.col("ancestor").isin(list(bases)) | F.substring_index("ancestor", "\\", -1).isin(list(bases))).select("child").distinct()


def authorize_available(classes: DataFrame, closure: DataFrame, having: DataFrame) -> DataFrame:
    """(class, availability): callable when it or something above has authorize(), absent when all above is known, else unknown.

    classes (class); having (class) that declare it or use the trait that does.
    """
    family = classes.select(F.col("class").alias("child"), F.col("class").alias("ancestor")).union(closure.select("child", "ancestor"))
    known = classes.select(F.col("class").alias("ancestor"), F.lit(True).alias("_known"))
    has = having.select(F.col("class").alias("ancestor"), F.lit(True).alias("_has")).distinct()
    seen = family.join(known, "ancestor", "left").join(has, "ancestor", "left").groupBy(F.col("child").alias("class")).agg(F.bool_or(F.coalesce("_has", F.lit(False))).alias("has"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("readable"))
    return seen.select("class", F.when(F.col("has"), "callable").when(F.col("readable"), "absent").otherwise("unknown").alias("availability"))


#: Classes and methods that tell what a receiver is, in order.
RECEIVERS = [
    ("http_client", ["Http", "Client", "PendingRequest"], ["withtoken", "withheaders", "timeout", "baseurl"]),
    ("storage", ["Storage", "File", "Filesystem"], ["disk"]),
    ("request", ["Request", "FormRequest"], ["input", "validated"]),
    ("eloquent", ["Model", "Builder", "DB"], ["where", "wherein", "orderby", "with", "find", "findorfail", "query", "newquery"]),
    ("collection", ["Collection", "LazyCollection"], ["map", "pluck", "filter", "collect"]),
]


def receiver_kind(class_, method):
    """Kind of a call's receiver by its class, else by a method only that kind has."""
    short, m = F.substring_index(class_, "\\", -1), F.lower(method)
    out = None
    for kind, names, _ in RECEIVERS:
        out = F.when(short.isin(names), kind) if out is None else out.when(short.isin(names), kind)
    out = out.when(short.endswith("Service"), "local_service")
    for kind, _, methods in RECEIVERS:
        out = out.when(class_.isNull() & m.isin(methods), kind)
    return out.otherwise("unknown")


def preferred_model(prices: DataFrame, tier: str) -> DataFrame:
    """(provider, model): each provider's first model of a tier that is no alias, else its first."""
    rank = F.when((F.col("tier") == tier) & F.col("alias_of").isNull(), 0).when(F.col("alias_of").isNull(), 1).otherwise(2)
    return prices.withColumn("_n", F.row_number().over(Window.partitionBy("provider").orderBy(rank, "ordinal"))).where("_n = 1").select("provider", "model")


def sections(parts: DataFrame, budget: int, by=("scan",)) -> DataFrame:
    """Context sections (name, priority, tokens, text) joined in order of priority while they fit the budget; one that does not is skipped."""
    from codequarry.operators.scans import admit

    took = admit(parts.select(*by, "priority", "tokens"), by, "priority", budget, 0)
    kept = parts.join(took.where("admitted").select(*by, "priority"), [*by, "priority"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("priority", "name", "text"))), lambda x: F.concat(F.lit("## "), x["name"], F.lit("\n"), x["text"]))
    return kept.groupBy(*by).agg(F.array_join(ordered, "\n\n").alias("context"), F.sum("tokens").alias("tokens"))


def middleware_of(routes: DataFrame, known: DataFrame, by: tuple = ()) -> DataFrame:
    """routes (route) with the middleware of the first known key, by ordinal, that holds the route's last word; none without one.

    known: (key, ordinal, middleware). Only the pieces of keys that are as long
    as some last word are laid out, so the words meet them by equality. With by
    (columns of both sides) routes meet the keys of their own group only.
    """
    word = F.trim(F.substring_index(F.concat(F.lit(" "), F.col("route")), " ", -1))
    asked = routes.select(*by, "route", word.alias("word")).distinct()
    sizes = asked.groupBy(*by).agg(F.collect_set(F.length("word")).alias("sizes"))  # an entry for each length
    met = known.join(sizes, list(by)) if by else known.join(F.broadcast(sizes))  # without by sizes is one row
    keys = met.select(*by, "key", "ordinal", "middleware", F.explode("sizes").alias("n")).where(F.col("n") <= F.length("key"))
    starts = F.when(F.col("n") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("key") - F.col("n") + 1))
    laid_out = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("key"), i, F.col("n"))))
    pieces = keys.select(*by, "ordinal", "middleware", F.explode(laid_out).alias("word"))
    first = asked.join(pieces, [*by, "word"]).groupBy(*by, "route").agg(F.min_by("middleware", "ordinal").alias("middleware"))
    none = F.array().cast("array<string>")
    return routes.join(first, [*by, "route"], "left").withColumn("middleware", F.coalesce("middleware", none))


def class_path(name):
    """The file of a class below the application's namespace; null for other classes."""
    return F.when(F.col(name).startswith("App\\"), F.concat(F.lit("app/"), F.replace(F.substring(F.col(name), F.lit(5), F.length(name)), F.lit("\\"), F.lit("/")), F.lit(".php")))


def used_files(controllers: DataFrame, files: DataFrame) -> DataFrame:
    """(path, class, used): the files of the classes that each controller imports, or names by their full name in a parameter.

    controllers: (path, content); files: (path). Classes meet files by the path
    that their namespace gives.
    """
    imports = F.regexp_extract_all("content", F.lit(r"(?m)^\s*use\s+\\?(App\\[A-Za-z0-9_\\]+)(?:\s+as\s+\w+)?\s*;"), F.lit(1))
    hints = F.regexp_extract_all("content", F.lit(r"[(,]\s*\\(App\\[A-Za-z0-9_\\]+)\s+\$\w+"), F.lit(1))
    named = controllers.select("path", F.explode(F.array_distinct(F.concat(imports, hints))).alias("class")).withColumn("used", class_path("class"))
    return named.join(files.select(F.col("path").alias("used")).distinct(), "used").select("path", "class", "used")
