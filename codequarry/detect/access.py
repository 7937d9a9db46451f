"""The five detectors over the facts of a corpus, and how their findings come together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry import registry as R
from codequarry.functions import rules
from codequarry.functions import text as T
from codequarry.operators import catalogue
from codequarry.operators import findings as O
from codequarry.php.facts import Facts

MODEL_BASES = ("Model", "Authenticatable", "Pivot", "MorphPivot", "User")
ABILITY = {"store": "create", "create": "create", "update": "update", "edit": "update", "destroy": "delete", "delete": "delete"}
NOT_ABILITIES = ("__construct", "before", "after", "allow", "deny", "denywithstatus", "denyasnotfound")
COLUMNS = ["path", "class_name", "method", "line", "type", "severity", "class", "confidence", "description", "proof"]


class Catalogue:
    """Facts joined to what holds for whole classes: kinds, guards, routes, policies.

    routes may come from elsewhere (a router's export); without any, the corpus'
    own route files count.
    """

    def __init__(self, facts: Facts, routes: DataFrame | None = None):
        self.facts = facts
        self.classes = facts.classes.dropDuplicates(["fqcn"]).persist()
        self.methods, self.uses = self.with_helpers(facts.methods).persist(), facts.uses.persist()
        self.routes = routes if routes is not None else facts.routes.select("verb", "uri", "class", "method", "middleware")
        links = self.classes.select(F.col("fqcn").alias("child"), F.explode(F.array_compact(F.concat(F.array("parent"), "traits"))).alias("parent"))
        self.up = catalogue.ancestors(links).select("child", "ancestor").persist()
        own = self.classes.select(F.col("fqcn").alias("child"), F.col("fqcn").alias("ancestor"))
        self.family = own.union(self.up)
        short = F.substring_index("ancestor", "\\", -1)
        kinds = self.up.groupBy(F.col("child").alias("fqcn")).agg(F.bool_or(short.isin(*MODEL_BASES)).alias("_m"), F.bool_or(short.endswith("Controller")).alias("_c"), F.bool_or(short.endswith("JsonResource") | short.endswith("ResourceCollection")).alias("_r"))
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        self.kinds = self.classes.join(kinds, "fqcn", "left").select("*", yes("_m").alias("is_model"), (yes("_c") | F.col("short").endswith("Controller")).alias("is_controller"), yes("_r").alias("is_resource")).drop("_m", "_c", "_r").persist()

    @staticmethod
    def with_helpers(methods: DataFrame) -> DataFrame:
        """Methods, guarded also when a helper of the same class that they call is; one level deep."""
        guards = methods.where("guarded").select("class", F.lower("method").alias("helper"))
        by = methods.select("class", "method", F.explode("helpers").alias("helper")).join(guards, ["class", "helper"], "left_semi").select("class", "method").distinct().withColumn("_by", F.lit(True))
        return methods.join(by, ["class", "method"], "left").withColumn("guarded", F.col("guarded") | F.coalesce("_by", F.lit(False))).drop("_by")

    def inherited(self, flag: str) -> DataFrame:
        """(class, flag) true where the class or one above it has the flag."""
        return self.family.join(self.classes.select(F.col("fqcn").alias("ancestor"), flag), "ancestor").groupBy(F.col("child").alias("class")).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag))

    def class_guards(self) -> DataFrame:
        """Classes that a constructor, here or above, or a class-wide rule guards."""
        built = self.methods.where("method = '__construct' and guarded").select(F.col("class").alias("ancestor")).union(self.classes.where("authorizes").select(F.col("fqcn").alias("ancestor")))
        return self._once("guards", lambda: self.family.join(built.distinct(), "ancestor", "left_semi").select(F.col("child").alias("class")).distinct())

    def _once(self, name: str, make) -> DataFrame:
        """A table that several detectors read, kept after the first."""
        if name not in self.__dict__:
            self.__dict__[name] = make().persist()
        return self.__dict__[name]

    def guarded_requests(self) -> DataFrame:
        """Methods with a form request whose authorize() decides something."""
        requests = self.methods.where("method = 'authorize' and not always_true").select(F.col("class").alias("type")).distinct()
        typed = self.methods.select("class", "method", F.explode("params.type").alias("type"))
        return self._once("requests", lambda: typed.join(requests, "type", "left_semi").select("class", "method").distinct())

    def of_models(self, rows: DataFrame) -> DataFrame:
        """Rows whose model is a model: a class that descends from one, or one not among the files that lies in a Models namespace (read is false then)."""
        known = self.kinds.select(F.col("fqcn").alias("model"), "is_model", "owner", "scoped", "bound", "hidden")
        out = rows.join(known, "model", "left").withColumn("read", F.col("is_model").isNotNull())
        return out.where(F.coalesce("is_model", F.col("model").contains("\\Models\\")))

    def entries(self) -> DataFrame:
        """(class, method, entry) of routed actions: routed when nothing on any of its routes may authorize."""
        inert = F.coalesce(rules.inert(F.col("middleware")), F.lit(True))
        return self._once("entry_rows", lambda: self.routes.where("verb <> 'HEAD'").groupBy("class", "method").agg(F.bool_and(inert).alias("open"), F.max(F.size("middleware")).alias("n_middleware")))

    def with_entry(self, rows: DataFrame) -> DataFrame:
        """Rows with entry: routed, unreachable, or unrouted when there is no route table at all."""
        some = self.routes.limit(1).select(F.lit(True).alias("_some"))
        known = rows.join(self.entries(), ["class", "method"], "left").join(F.broadcast(some), F.lit(True), "left")
        entry = F.when(F.col("open"), "routed").when(F.col("open").isNotNull() | F.col("_some").isNotNull(), "unreachable").otherwise("unrouted")
        return known.withColumn("entry", entry).drop("_some")


def _finding(df: DataFrame, type_: str, severity, class_, confidence, description, proof=None) -> DataFrame:
    lit = lambda x: x if not isinstance(x, str) else F.lit(x)
    return df.select(
        "path", F.col("class").alias("class_name"), "method", "line", F.lit(type_).alias("type"), lit(severity).alias("severity"), lit(class_).alias("class_"), lit(confidence).alias("confidence"),
        description.alias("description"), (proof if proof is not None else F.lit("")).alias("proof"),
    ).withColumnRenamed("class_", "class")


def model_fetch(c: Catalogue) -> DataFrame:
    """Records fetched, changed or bound by a client's id without guard, owner condition or scope."""
    rows = c.uses.where(F.col("kind").isin("fetch", "mutation", "binding") & (F.col("trust") == "tainted") & (F.col("reach") == "full"))
    controllers = c.kinds.where("is_controller and not abstract").select(F.col("fqcn").alias("class"))
    methods = c.methods.where("visibility = 'public' and not static and method <> '__construct' and not guarded").select("class", "method", "params")
    rows = rows.join(controllers, "class", "left_semi").join(methods, ["class", "method"]).join(c.class_guards(), "class", "left_anti").join(c.guarded_requests(), ["class", "method"], "left_anti")
    rows = rows.where(~F.exists("columns", lambda x: F.substring_index(x, ".", -1).isin(R.OWNERSHIP_COLUMNS)))
    rows = rows.where((F.col("kind") == "binding") | rules.identifier_like(F.col("label")))
    rows = rows.where((F.col("kind") != "fetch") | F.col("responds"))
    # A model that is not among the files may be scoped or owned in ways nobody has read.
    rows = c.with_entry(c.of_models(rows).where("(not read and kind <> 'binding') or (owner and not scoped and not (kind = 'binding' and bound))"))
    middle = c.inherited("has_middleware")
    rows = rows.join(middle, "class", "left").where("entry <> 'unreachable' and not (kind = 'binding' and (entry <> 'routed' or coalesce(has_middleware, false)))")
    rows = rows.where((F.col("entry") == "routed") | F.col("source").startswith("request"))
    sure = (F.col("entry") == "routed") & (F.col("kind") != "binding") & F.col("read")
    what = F.concat(F.lit("A record of "), F.substring_index("model", "\\", -1), F.when(F.col("kind") == "mutation", " is changed").when(F.col("kind") == "binding", " is bound").otherwise(" is read"), F.lit(" by the client's "), F.col("label"), F.lit(" without an ownership check."))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path", "class", "method", "line").orderBy("kind", "label"))).where("_n = 1")
    return _finding(first, "idor", "high", F.when(sure, "vulnerability").otherwise("review"), F.when(sure, "proven").otherwise("possible"), what, F.concat(F.col("source"), F.lit(" -> "), F.col("detail")))


def policy_mismatch(c: Catalogue) -> DataFrame:
    """Changing actions whose model has a policy with the ability that nothing applies."""
    ability = F.create_map(*[F.lit(x) for kv in ABILITY.items() for x in kv])
    controllers = c.kinds.where("is_controller and not abstract").select(F.col("fqcn").alias("class"), F.regexp_replace("short", "Controller$", "").alias("named"))
    acts = c.methods.where("visibility = 'public' and not static and not guarded").withColumn("ability", F.try_element_at(ability, F.lower("method"))).where("ability is not null")
    acts = acts.join(controllers, "class").join(c.class_guards(), "class", "left_anti").join(c.guarded_requests(), ["class", "method"], "left_anti").select("path", "class", "method", "line", "ability", "named")
    policies = c.methods.where(F.col("class").endswith("Policy") & (F.col("visibility") == "public") & ~F.lower("method").isin(*NOT_ABILITIES))
    declared = policies.select(F.lower(F.regexp_replace(F.substring_index("class", "\\", -1), "Policy$", "")).alias("short"), F.lower("method").alias("ability")).distinct()
    models = c.kinds.where("is_model").select(F.col("fqcn").alias("model"), F.lower("short").alias("short"))
    touched = c.facts.touches.join(models, "model").select("class", "method", "model", "short")
    found = acts.join(touched, ["class", "method"]).join(declared, ["short", "ability"])
    count = Window.partitionBy("class", "method")
    fits = F.col("short") == F.lower("named")
    found = found.withColumn("_all", F.size(F.collect_set("model").over(count))).withColumn("_fit", F.max(fits.cast("int")).over(count)).where((F.col("_all") == 1) | fits).dropDuplicates(["class", "method"])
    has = c.routes.select("class").distinct().withColumn("_known", F.lit(True))
    found = c.with_entry(found).join(has, "class", "left").where(~((F.col("entry") == "unreachable") & F.col("_known").isNotNull() & F.col("open").isNull()) & ~(F.coalesce(F.col("open"), F.lit(True)) == F.lit(False)))
    unread = c.up.join(c.classes.select(F.col("fqcn").alias("ancestor")), "ancestor", "left_anti").where(~F.col("ancestor").startswith("Illuminate\\")).select(F.col("child").alias("class")).distinct().withColumn("_unread", F.lit(True))
    found = found.join(unread, "class", "left")
    sure = (F.col("entry") == "routed") & (F.col("n_middleware") > 0) & F.col("_unread").isNull()
    what = F.concat(F.lit("The policy of "), F.substring_index("model", "\\", -1), F.lit(" declares "), F.col("ability"), F.lit(", but "), F.col("method"), F.lit("() never asks it."))
    return _finding(found, "auth_bypass", "high", F.when(sure, "vulnerability").otherwise("review"), F.when(sure, "proven").otherwise("possible"), what)


def sensitive_fillable(c: Catalogue) -> DataFrame:
    """Privilege columns that request data can fill wholesale."""
    models = c.kinds.where("is_model and size(fillable) > 0 and not coalesce(array_contains(guarded, '*'), false)")
    fields = models.select("path", F.col("fqcn").alias("model"), "fillable", "parent", F.coalesce("guarded", F.array().cast("array<string>")).alias("guarded"), F.coalesce(F.map_keys("casts"), F.array().cast("array<string>")).alias("cast_names"), F.explode(F.arrays_zip("fillable", "fillable_lines")).alias("f"))
    fields = fields.select("*", F.col("f.fillable").alias("field"), F.coalesce("f.fillable_lines", F.lit(1)).alias("line")).drop("f")
    fields = fields.where("field not in ('', '*') and not array_contains(guarded, field)")
    siblings = F.array(*[F.lit(s) for s in R.PRIVILEGE_SIBLINGS])
    others = F.filter("fillable", lambda x: x != F.col("field"))
    backed = F.arrays_overlap(others, siblings) | F.arrays_overlap(F.filter("cast_names", lambda x: x != F.col("field")), siblings)
    logs_in = F.coalesce(F.substring_index("parent", "\\", -1).isin("Authenticatable", "User"), F.lit(False)) | F.array_contains("fillable", "password")
    fields = fields.withColumn("severity", rules.privilege_field(F.col("field"), logs_in, backed)).where("severity is not null")
    sinks = c.uses.where("kind = 'fill'").select(F.col("model").alias("used"), F.struct(F.col("detail").alias("kind"), F.col("columns").alias("fields")).alias("reach"), F.col("path").alias("sink_path"), F.col("line").alias("sink_line"), F.col("class").alias("sink_class"), F.col("method").alias("sink_method"))
    family = c.family.select(F.col("child").alias("used"), F.col("ancestor").alias("model"))
    reached = fields.join(family, "model").join(sinks, "used").where(catalogue.reaches(F.col("reach"), F.col("field")))
    first = reached.groupBy("model", "field").agg(F.min(F.struct("sink_path", "sink_line", "sink_class", "sink_method")).alias("at"))
    both = fields.join(first, ["model", "field"], "left").where(F.col("at").isNotNull() | F.col("field").isin(R.ALWAYS_PRIVILEGE))
    both = both.withColumn("class", F.coalesce("at.sink_class", "model")).withColumn("method", F.coalesce("at.sink_method", F.lit("")))
    hit = F.col("at").isNotNull()
    what = F.concat(F.lit("The fillable column "), F.col("field"), F.when(hit, " is reached by request data as a whole.").otherwise(" decides privileges; may a client set it?"))
    proof = F.when(hit, F.concat(F.col("at.sink_path"), F.lit(":"), F.col("at.sink_line").cast("string"))).otherwise("")
    return _finding(both, "mass_assignment", F.col("severity"), F.when(hit, "vulnerability").otherwise("review"), F.when(hit, "proven").otherwise("possible"), what, proof)


def ssrf(c: Catalogue) -> DataFrame:
    """The first sink of a method that request data reaches in full, unless it is constrained."""
    controllers = c.kinds.where("is_controller").select(F.col("fqcn").alias("class"))
    rows = c.uses.where("kind = 'url' and trust = 'tainted' and reach = 'full'").join(controllers, "class", "left_semi")
    rows = rows.where(~F.col("detail").isin("file_get_contents", "fopen") | rules.url_word(F.col("label")) | rules.url_word(F.col("source")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path", "class", "method").orderBy("line", "label"))).where("_n = 1 and size(columns) = 0")
    return _finding(first, "ssrf", "high", "vulnerability", "probable", F.concat(F.lit("The address requested by "), F.col("detail"), F.lit("() comes from "), F.col("source"), F.lit(".")), F.concat(F.lit("source: "), F.col("source")))


def data_exposure(c: Catalogue) -> DataFrame:
    """Secret attributes of models in what a method returns; one finding a method, sure ones first."""
    holders = c.kinds.where("is_controller or is_resource").select(F.col("fqcn").alias("class"))
    rows = c.uses.where("kind = 'expose'").where(rules.secret_name(F.col("label"))).join(holders, "class", "left_semi")
    public = c.methods.where("visibility = 'public' and not static and not abstract").select("class", "method", "guarded")
    rows = rows.join(public, ["class", "method"])
    kinds = c.kinds.select(F.col("fqcn").alias("class"), "is_resource")
    rows = rows.join(kinds, "class")
    own = rows.where("is_resource and model = ''").withColumn("read", F.lit(True))
    rows = c.of_models(rows.where("model <> ''")).select(*own.columns).unionByName(own)
    sure = (F.size("columns") == 0) & ~F.col("guarded") | (F.col("is_resource") & ~F.array_contains("columns", "when") & ~F.col("guarded"))
    rows = rows.withColumn("sure", sure).withColumn("_n", F.row_number().over(Window.partitionBy("path", "class", "method").orderBy(F.desc("sure"), "line", "label"))).where("_n = 1")
    return _finding(rows, "sensitive_data_exposure", "high", F.when(F.col("sure"), "vulnerability").otherwise("review"), F.when(F.col("sure"), "proven").otherwise("possible"), F.concat(F.lit("The response carries "), F.col("label"), F.lit(".")))


DETECTORS = [model_fetch, policy_mismatch, sensitive_fillable, ssrf, data_exposure]


def analyse(facts: Facts, routes: DataFrame | None = None, detectors=None) -> DataFrame:
    """Findings of all detectors in order, exact repeats dropped, and IDs under an authorization gap dropped."""
    c = Catalogue(facts, routes)
    parts = [d(c).withColumn("detector", F.lit(n)) for n, d in enumerate(detectors or DETECTORS)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("ordinal", F.struct("detector", "path", "line", "description")).withColumnRenamed("path", "location").withColumn("scan_id", F.lit(0))
    rows = O.drop_exact(rows)
    gaps = rows.where("type = 'auth_bypass'").select("location", "class_name", "method").join(c.methods.select(F.col("path").alias("location"), F.col("class").alias("class_name"), "method", F.col("line").alias("start"), F.col("end_line").alias("end")), ["location", "class_name", "method"]).select("location", "start", "end")
    idors = O.outside_spans(rows.where("type = 'idor'"), gaps)
    out = rows.where("type <> 'idor'").unionByName(idors)
    return out.select("location", "class_name", "method", "line", "type", "severity", "class", "confidence", "description", "proof", "detector").withColumn("fix", F.lit("")).withColumn("line", F.col("line").cast("int"))


def explain(spark, type_: str) -> DataFrame:
    """The registry's entry of a type, however it is spelled."""
    return spark.createDataFrame([(type_,)], "given string").select(T.type_of(F.col("given")).alias("type")).join(O.types_table(spark), "type").join(O.references_table(spark), "type")
