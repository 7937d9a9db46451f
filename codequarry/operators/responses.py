"""Findings out of model responses: JSON that is whole, fenced, inside prose, cut off or malformed.

All of it is expressions, per row and in the JVM. JSON is parsed as VARIANT;
what stands in prose is found by a bracket automaton, a fold over the tokens
that follow each brace at which an object can begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import rules, text as T
from codequarry.operators.catalogue import resolve_location
from codequarry.operators.lineage import checkpointed
from codequarry.registry import DEFAULT_TYPE, TYPES

KEY = "vulnerabilities"
_BLANK = "[ \\n\\r\\t\\x0B\\x00]+"
_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
_OBJECT_START = r"\{(?=[ \n\r\t]*[\"}])"
# Strings (the last may be cut off), what structures, and all between; possessive, so that a long string takes no stack.
_TOKEN = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|[{}\[\]:]|[^"{}\[\]:]+'
_END = '"end of the value"'


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _reports(value: Column) -> Column:
    """Whether a parsed value is a list, or an object with the key."""
    return F.coalesce((kind_of(value) == "ARRAY") | _get(value, f"$.{KEY}").isNotNull(), F.lit(False))


def whole_json(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else; null otherwise."""
    both = _get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f", {_END}]"))), "$", "array<variant>")
    return F.when(F.size(both) == 2, F.get(both, F.lit(0)))


def _tokens(text: Column) -> Column:
    """A text that begins with a brace, in tokens without gaps."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _object_starts(text: Column) -> Column:
    """What follows each place at which an object can begin, that included."""
    parts = F.split(text, f"(?={_OBJECT_START})", -1)
    rest = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ""))
    return F.filter(rest, lambda s: s.rlike(f"^{_OBJECT_START}"))


def _balanced(text: Column) -> Column:
    """The object that a text begins with, to its closing brace; null if it has none."""
    zero = F.lit(0)

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = s["at"] + F.length(token)
        done = (s["end"] == 0) & (token == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(done, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(_tokens(text), F.struct(zero.alias("depth"), zero.alias("at"), zero.alias("end")), step, lambda s: s["end"])
    return F.when(end > 0, F.left(text, end))


def embedded(text: Column) -> Column:
    """The first object in a text that parses and has the key; an object that parses without it is jumped over."""
    tried = F.transform(_object_starts(text), lambda s: F.struct(F.length(s).alias("left"), _balanced(s).alias("json")))
    none = F.lit(None).cast("string")

    def step(s: Column, x: Column) -> Column:
        value = whole_json(x["json"])
        open_ = s["found"].isNull() & (x["left"] <= s["left"]) & value.isNotNull()
        found = F.when(open_ & _get(value, f"$.{KEY}").isNotNull(), x["json"]).otherwise(s["found"])
        return F.struct(F.when(open_, x["left"] - F.length(x["json"])).otherwise(s["left"]).alias("left"), found.alias("found"))

    return F.aggregate(tried, F.struct(F.length(text).alias("left"), none.alias("found")), step, lambda s: s["found"])


def _elements_so_far(text: Column) -> Column:
    """(found, closed, items): the whole elements of the list under the key in an object that need not close or parse."""
    no, zero = F.lit(False), F.lit(0)
    names = ("depth", "at", "last", "awaits", "open", "found", "start", "items", "closed")
    begin = (zero, zero, F.lit(""), no, no, no, F.lit(-1), F.array().cast("array<struct<at:int,n:int>>"), no)

    def step(s: Column, token: Column) -> Column:
        c = F.left(token, F.lit(1))
        up, down, blank = c.isin("{", "["), c.isin("}", "]"), token.rlike(r"^[ \n\r\t]+$")
        depth = s["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
        opens = s["awaits"] & (c == "[") & (depth == 2)
        begins = (c == "{") & s["open"] & (depth == 3)
        ends = (c == "}") & s["open"] & (depth == 2) & (s["start"] >= 0)
        item = F.struct(s["start"].alias("at"), (s["at"] + 1 - s["start"]).alias("n"))
        out = {
            "depth": depth,
            "at": s["at"] + F.length(token),
            "last": F.when((c == '"') & (s["depth"] == 1), token).otherwise(s["last"]),
            "awaits": F.when(blank, s["awaits"]).otherwise((c == ":") & (s["depth"] == 1) & (s["last"] == f'"{KEY}"')),
            "open": F.when(opens, True).when((c == "]") & (depth == 1), False).otherwise(s["open"]),
            "found": s["found"] | opens,
            "start": F.when(begins, s["at"]).when(ends, -1).otherwise(s["start"]),
            "items": F.when(ends, F.concat(s["items"], F.array(item))).otherwise(s["items"]),
            "closed": down & (depth == 0),
        }
        moved = F.struct(*[out[n].alias(n) for n in names])
        return F.when(s["closed"], s).otherwise(moved)

    state = F.aggregate(_tokens(text), F.struct(*[x.alias(n) for n, x in zip(names, begin)]), step)
    items = F.transform(state["items"], lambda x: F.substring(text, x["at"] + 1, x["n"]))
    return F.struct(state["found"].alias("found"), state["closed"].alias("closed"), F.filter(items, lambda x: whole_json(x).isNotNull()).alias("items"))


def salvaged(text: Column) -> Column:
    """(closed, items) of the first object of a text that has a list under the key, whole or not."""
    tried = F.filter(F.transform(_object_starts(text), _elements_so_far), lambda x: x["found"])
    return F.get(tried, F.lit(0))


def parse(responses: DataFrame, text: str = "response") -> DataFrame:
    """Responses with state and elements, and the report's overall_score, summary and ctf_idea.

    elements are the JSON of what is reported, one by one. In turn: the response
    itself, its first fenced block, the first object in it that has the key; a
    list is taken for the key's value. Where nothing parses, the whole elements of
    a list that was cut off are kept (state truncated), or of an object that
    closes but does not parse (state ok). A response that parses without the key,
    whose key holds no list or object, with nothing to keep, and a null one are
    failed. Repeated keys and other JSON that Spark does not parse count as
    malformed. Responses are parsed once, into the checkpoint folder.
    """
    t = _stripped(F.col(text))
    fence = F.when(t.rlike(_FENCE), _stripped(F.regexp_extract(t, _FENCE, 1)))
    out = responses.withColumns({"_t": t, "_f": fence})
    own, fenced = whole_json(F.col("_t")), whole_json(F.col("_f"))
    direct = F.when(_reports(own), F.col("_t")).when(_reports(fenced), F.col("_f"))
    keyless = F.coalesce(kind_of(own) == "OBJECT", F.lit(False)) | F.coalesce(kind_of(fenced) == "OBJECT", F.lit(False))
    out = out.withColumn("_direct", direct).withColumn("_keyless", keyless)
    out = out.withColumn("_json", F.coalesce("_direct", F.when(F.col("_direct").isNull(), embedded(F.col("_t")))))
    out = out.withColumn("_kept", F.when(F.col("_json").isNull() & ~F.col("_keyless"), salvaged(F.col("_t"))))
    value = whole_json(F.col("_json"))
    held = F.when(kind_of(value) == "ARRAY", value).otherwise(_get(value, f"$.{KEY}"))
    listed = F.when(kind_of(held) == "ARRAY", _get(held, "$", "array<variant>")).when(kind_of(held) == "OBJECT", F.map_values(_get(held, "$", "map<string,variant>")))
    texts = F.transform(listed, lambda x: F.to_json(x))
    empty_list = (kind_of(value) == "ARRAY") & (F.size(listed) == 0)
    recovered = F.when(F.col("_kept.closed") | (F.size("_kept.items") > 0), F.col("_kept.items"))
    out = out.withColumn("elements", F.when(F.col("_json").isNull(), recovered).when(~empty_list, texts))
    state = F.when(F.col("elements").isNull(), "failed").when(F.col("_json").isNull() & ~F.col("_kept.closed"), "truncated").otherwise("ok")
    text_of = lambda name: F.when(kind_of(_get(value, f"$.{name}")) == "STRING", _get(value, f"$.{name}", "string"))
    score = _scalar(value, "overall_score")
    out = out.withColumns({"state": state, "overall_score": score, "summary": F.coalesce(text_of("summary"), F.lit("")), "ctf_idea": F.coalesce(text_of("ctf_idea"), F.lit(""))})
    return checkpointed(out.drop("_t", "_f", "_direct", "_keyless", "_json", "_kept"))


def _scalar(value: Column, name: str) -> Column:
    """A string or number as text; null for anything else."""
    return F.when(kind_of(_get(value, f"$.{name}")).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), _get(value, f"$.{name}", "string"))


def to_findings(parsed: DataFrame, by=("chunk",), files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, rejected with a reason) of parsed responses.

    Only an entry's type and location can make it go; all else has defaults. With
    files (path, lines) a location must mean one of them, and lines end with it.
    Findings that contradict themselves, or whose trace is no user input's, go
    without a reason.
    """
    value = F.parse_json("v")
    field = lambda name: F.when(kind_of(_get(value, f"$.{name}")) == "STRING", _get(value, f"$.{name}", "string"))
    rows = parsed.select(*by, F.posexplode("elements").alias("ordinal", "v"))
    texts = {f"_{name}": F.coalesce(_scalar(value, name), F.lit("")) for name in ("line", "description", "proof", "fix")}
    texts |= {"_type": field("type"), "_location": field("location"), "_severity": F.coalesce(field("severity"), F.lit("")), "_trace": F.nullif(_stripped(field("taint_trace")), F.lit(""))}
    rows = rows.withColumns({"_entry": kind_of(value).isin("OBJECT", "ARRAY")} | texts).drop("v")
    rows = checkpointed(checkpointed(rows).withColumn("_kind", T.type_of(F.col("_type"))))  # both outputs read them
    type_ = F.col("_kind")
    reason = F.when(~F.col("_entry"), "not an object").when(type_.isNull(), "unknown type").when(_stripped(F.coalesce("_location", F.lit(""))) == "", "no location")
    rows = rows.withColumns({"reason": reason, "_at": T.normal_path(F.col("_location")), "_lines": F.lit(None).cast("long")})
    if files is not None:
        asked = rows.where("reason is null").select(F.col("_at").alias("id"), F.col("_at").alias("location")).distinct()
        known = resolve_location(asked, files).join(files.select("path", F.col("lines").alias("_n")), "path")
        rows = rows.join(known.select(F.col("id").alias("_at"), "path", "_n"), "_at", "left")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("path").isNull(), "no such file"))).withColumns({"_at": F.coalesce("path", "_at"), "_lines": F.col("_n").cast("long")})
    line = T.to_line(F.col("_line"))
    line = F.when(F.col("_lines").isNull(), line).otherwise(F.least(line, F.greatest("_lines", F.lit(1).cast("long"))))
    label = F.coalesce(*[F.when(F.col("_kind") == t[0], t[1]) for t in TYPES], F.lit(""))
    keep = rows.where("reason is null").select(
        *by, F.col("ordinal").cast("long").alias("ordinal"), F.col("_kind").alias("type"), F.col("_at").alias("location"), line.cast("int").alias("line"),
        T.severity_of(F.col("_severity")).alias("severity"), F.when(F.col("_description") == "", label).otherwise(F.col("_description")).alias("description"),
        F.col("_proof").alias("proof"), F.col("_fix").alias("fix"), F.col("_trace").alias("taint_trace"), F.lit("vulnerability").alias("class"), F.lit("probable").alias("confidence"),
    )
    keep = keep.where(~rules.contradicts_itself(F.col("description")) & ~rules.broken_trace(F.col("type"), F.col("taint_trace")))
    return keep, rows.where("reason is not null").select(*by, "ordinal", "reason")


def report_heads(parsed: DataFrame, findings: DataFrame, by=("chunk",)) -> DataFrame:
    """(by..., state, score, summary, ctf_idea) of the responses that did not fail: the given score, else 100 less the findings' weights."""
    penalty = findings.groupBy(*by).agg(F.sum(T.weight_of(F.col("severity"))).alias("_penalty"), F.count("*").alias("_n"))
    rows = parsed.where("state <> 'failed'").join(penalty, list(by), "left")
    cut = F.concat(F.lit("The response was cut off; "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" whole findings were recovered, later files may not have been analysed."))
    summary = F.when((F.col("summary") == "") & (F.col("state") == "truncated"), cut).otherwise(F.col("summary"))
    return rows.select(*by, "state", T.to_score(F.col("overall_score"), F.coalesce("_penalty", F.lit(0))).alias("score"), summary.alias("summary"), "ctf_idea")


def type_or_default(col):
    return F.coalesce(T.type_of(col), F.lit(DEFAULT_TYPE))
