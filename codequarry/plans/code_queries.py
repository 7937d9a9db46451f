"""Queries that read code: a generated application of one controller and one model a supplier.

The kind of a controller follows from its number, so the findings are known
beforehand and SQL can state them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.detect.access import analyse
from codequarry.php.facts import Facts
from codequarry.plans.surrogates import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


MODEL = """<?php
namespace App\\Models;
use Illuminate\\Database\\Eloquent\\Model;
class MKK extends Model {
    protected $fillable = [
        'user_id_note',
        'is_admin',
    ];
    public function owner() { return $this->belongsTo(User::class, 'user_id'); }
}
"""
HEAD = """<?php
namespace App\\Http\\Controllers;
use App\\Models\\MKK;
use Illuminate\\Http\\Request;
use Illuminate\\Support\\Facades\\Http;
class CKKController extends Controller {
"""
BODIES = [
    "    public function act($id) {\n        $m = MKK::findOrFail($id);\n        return response()->json($m);\n    }\n",
    "    public function act($id) {\n        $m = MKK::findOrFail($id);\n        $this->authorize('view', $m);\n        return response()->json($m);\n    }\n",
    "    public function act(Request $request) {\n        $u = $request->input('url');\n        return Http::get($u)->body();\n    }\n",
    "    public function act(Request $request) {\n        return MKK::create($request->all());\n    }\n",
    "    public function act($id) {\n        return MKK::where('user_id', auth()->id())->findOrFail($id);\n    }\n",
    "    public function act(Request $request) {\n        return MKK::create($request->only(['name']));\n    }\n",
]


def application(spark, sf):
    """(files, routes) of the application."""
    k = F.col("s_suppkey").cast("string")
    body = F.element_at(F.array(*[F.lit(HEAD + b + "}\n") for b in BODIES]), (F.col("s_suppkey") % len(BODIES) + 1).cast("int"))
    s = table(spark, sf, "supplier").select("s_suppkey")
    models = s.select(F.concat(F.lit("app/Models/M"), k, F.lit(".php")).alias("path"), F.replace(F.lit(MODEL), F.lit("KK"), k).alias("content"))
    controllers = s.select(F.concat(F.lit("app/Http/Controllers/C"), k, F.lit("Controller.php")).alias("path"), F.replace(body, F.lit("KK"), k).alias("content"))
    routes = s.select(F.lit("GET").alias("verb"), F.concat(F.lit("/c"), k).alias("uri"), F.concat(F.lit("App\\Http\\Controllers\\C"), k, F.lit("Controller")).alias("class"), F.lit("act").alias("method"), F.array(F.lit("web"), F.lit("auth")).alias("middleware"))
    return models.union(controllers), routes


@query("""SELECT 'app/Http/Controllers/C' || s_suppkey || 'Controller.php' AS location, 'act' AS method, 8 AS line, 'idor' AS type, 'vulnerability' AS class, 'proven' AS confidence FROM supplier WHERE s_suppkey % 6 = 0
UNION ALL SELECT 'app/Http/Controllers/C' || s_suppkey || 'Controller.php', 'act', 9, 'ssrf', 'vulnerability', 'probable' FROM supplier WHERE s_suppkey % 6 = 2
UNION ALL SELECT 'app/Models/M' || s_suppkey || '.php', CASE WHEN s_suppkey % 6 = 3 THEN 'act' ELSE '' END, 7, 'mass_assignment', CASE WHEN s_suppkey % 6 = 3 THEN 'vulnerability' ELSE 'review' END, CASE WHEN s_suppkey % 6 = 3 THEN 'proven' ELSE 'possible' END FROM supplier""")
def detect_findings(spark, sf):
    files, routes = application(spark, sf)
    return analyse(Facts(files), routes).select("location", "method", "line", "type", "class", "confidence")


@query("SELECT 'App\\Http\\Controllers\\C' || s_suppkey || 'Controller' AS class, 'act' AS method, s_suppkey % 6 = 1 AS guarded, 7 AS line, CAST([10, 11, 10, 9, 9, 9][CAST(s_suppkey % 6 AS INT) + 1] AS INT) AS end_line FROM supplier UNION ALL SELECT 'App\\Models\\M' || s_suppkey, 'owner', false, 9, 9 FROM supplier")
def code_methods(spark, sf):
    return Facts(application(spark, sf)[0]).methods.select("class", "method", "guarded", "line", "end_line")


@query("SELECT 'App\\Models\\M' || s_suppkey AS fqcn, 'Illuminate\\Database\\Eloquent\\Model' AS parent, 'user_id_note,is_admin' AS fillable, 4 AS line FROM supplier UNION ALL SELECT 'App\\Http\\Controllers\\C' || s_suppkey || 'Controller', 'App\\Http\\Controllers\\Controller', NULL, 6 FROM supplier")
def code_classes(spark, sf):
    return Facts(application(spark, sf)[0]).classes.select("fqcn", "parent", F.array_join("fillable", ",").alias("fillable"), "line")


@query("SELECT 'app/Http/Controllers/C' || s_suppkey || 'Controller.php' AS path, 'm' AS name, 8 AS line FROM supplier WHERE s_suppkey % 6 IN (0, 1) UNION ALL SELECT 'app/Http/Controllers/C' || s_suppkey || 'Controller.php', 'u', 8 FROM supplier WHERE s_suppkey % 6 = 2")
def code_assignments(spark, sf):
    return Facts(application(spark, sf)[0]).assignments.select("path", "name", "line")
