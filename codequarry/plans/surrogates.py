"""The driver's tables as the engine's entities, for Spark and for SQL.

finding: lineitem with its order. type by supplier, location by part, line by
line number, severity by order priority, confidence by return flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.findings import normalise
from codequarry.registry import TYPES

ORDER = ("scan_id", "line", "part", "supp", "price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    """values[index], as an expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({index} AS INT) + 1]"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = li.join(od, li.l_orderkey == od.o_orderkey)
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    confidence = F.when(F.col("l_returnflag") == "A", "proven").when(F.col("l_returnflag") == "R", "probable").otherwise("possible")
    return normalise(
        rows.select(
            F.col("l_orderkey").alias("scan_id"), F.col("o_custkey").alias("target"), pick([t[0] for t in TYPES], F.col("l_suppkey") % 25).alias("type"),
            F.concat(F.lit("app/F"), (F.col("l_partkey") % 50).cast("string"), F.lit(".php")).alias("location"), F.col("l_linenumber").alias("line"), severity.alias("severity"),
            F.concat(F.lit("part "), (F.col("l_partkey") % 100).cast("string")).alias("description"), F.lit("").alias("proof"), F.concat(F.lit("fix "), F.col("l_partkey").cast("string")).alias("fix"),
            F.lit("vulnerability").alias("class"), confidence.alias("confidence"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipped"),
            F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
        )
    )


FINDINGS = f"""f AS (SELECT l_orderkey AS scan_id, o_custkey AS target, {sql_pick([t[0] for t in TYPES], "l_suppkey % 25")} AS type, 'app/F' || (l_partkey % 50) || '.php' AS location, l_linenumber AS line,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  'part ' || (l_partkey % 100) AS description, CASE WHEN l_returnflag IN ('A', 'R') THEN 'fix ' || l_partkey ELSE '' END AS fix,
  CASE WHEN l_returnflag IN ('A', 'R') THEN 'vulnerability' ELSE 'review' END AS class, CASE l_returnflag WHEN 'A' THEN 'proven' WHEN 'R' THEN 'probable' ELSE 'possible' END AS confidence,
  l_linestatus AS status, l_shipdate AS shipped, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price,
  CASE o_orderpriority WHEN '1-URGENT' THEN 40 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 10 ELSE 5 END AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TOKEN = "CASE WHEN type IN ('idor', 'auth_bypass') THEN 'access_control' ELSE type END"
