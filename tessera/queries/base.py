"""The binding of the operators' roles to the star-schema tables, in Spark and in DuckDB SQL.

geo1 nation, geo2 customer, year of the order; price = extended price / quantity,
weight = quantity; imputed = returned, observed = line status F; provider type =
order priority, age = market segment, channel = order status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import weighted as W

CORE_FIRST, CORE_LAST, SENSITIVITY = 1996, 2000, 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with its place, year and roles."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("c_nationkey").alias("geo1"), F.col("c_custkey").alias("geo2"), "year", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("weight"), (F.col("l_returnflag") == "R").alias("imputed"), (F.col("l_linestatus") == "F").alias("observed"),
        F.col("o_orderpriority").alias("provider"), F.col("c_mktsegment").alias("age"), F.col("o_orderstatus").alias("channel"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("discount"),
    )


MICRO = """micro AS (SELECT c_nationkey AS geo1, c_custkey AS geo2, CAST(year(o_orderdate) AS INT) AS year, l_extendedprice / l_quantity AS price,
  l_quantity AS weight, l_returnflag = 'R' AS imputed, l_linestatus = 'F' AS observed, o_orderpriority AS provider, c_mktsegment AS age,
  o_orderstatus AS channel, l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey, l_returnflag AS flag,
  l_extendedprice AS amount, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county-year panel: price (A1), imputed share, population, wages, firms. Missing values by a fixed rule."""
    m = micro(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_retailprice")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_acctbal")
    rows = m.join(parts, "partkey").join(suppliers, "suppkey")
    some = lambda c, k: F.when(F.col("geo2") % k == 0, F.lit(None)).otherwise(c)
    panel = rows.groupBy("geo1", "geo2", "year").agg(
        W.weighted_mean_strict("price", "weight").alias("price"),
        F.avg(F.col("imputed").cast("double")).alias("imputed_share"),
        F.avg(F.col("observed").cast("double")).alias("observed_share"),
        F.count("*").alias("n"), F.sum("weight").alias("population"),
        F.avg("p_retailprice").alias("wage"), F.avg("s_acctbal").alias("outside"),
        F.sum(F.when(F.col("flag") == "N", F.col("weight"))).alias("establishments"),
        F.sum(F.when(F.col("flag") == "A", F.col("weight"))).alias("nonemployers"),
    )
    return panel.withColumns({"wage": some(F.col("wage") / 40, 7), "outside": some(F.col("outside"), 5)})


COUNTY = f"""{MICRO},
county AS (SELECT geo1, geo2, year, sum(price * weight) / sum(weight) AS price, avg(CAST(imputed AS DOUBLE)) AS imputed_share,
  avg(CAST(observed AS DOUBLE)) AS observed_share, count(*) AS n, sum(weight) AS population,
  CASE WHEN geo2 % 7 = 0 THEN NULL ELSE avg(p_retailprice) / 40 END AS wage, CASE WHEN geo2 % 5 = 0 THEN NULL ELSE avg(s_acctbal) END AS outside,
  sum(CASE WHEN flag = 'N' THEN weight END) AS establishments, sum(CASE WHEN flag = 'A' THEN weight END) AS nonemployers
  FROM micro JOIN part ON partkey = p_partkey JOIN supplier ON suppkey = s_suppkey GROUP BY geo1, geo2, year)"""

_A2 = "coalesce(sum(CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN {v} * {w} END) / sum(CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN {w} END), avg({v}))"


def a2(value: str, weight: str) -> str:
    return _A2.format(v=value, w=weight)


STATE_MEASURES = ["price", "imputed_share", "observed_share", "wage", "outside"]


def state(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """The state-year panel: population-weighted county measures. ``panel``: the county panel, where a query has it staged."""
    return W.to_groups(county(spark, sf_dir) if panel is None else panel, ["geo1", "year"], STATE_MEASURES, "population", "population")


STATE = f"""{COUNTY},
state AS (SELECT geo1, year, {", ".join(f"{a2(m, 'population')} AS {m}" for m in STATE_MEASURES)}, sum(population) AS population
  FROM county GROUP BY geo1, year)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
