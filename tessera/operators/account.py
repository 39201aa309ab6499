"""Satellite account, window summaries, support counts, release tables and the data contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import weighted as W


def satellite(county: DataFrame, hours: DataFrame, year: str = "year", hours_in_year: float = 52.0) -> DataFrame:
    """National prices (A2 by population) with hours: hourly price, bridge quantity, value layers, coverage share."""
    prices = county.groupBy(year).agg(W.weighted_mean_or_mean("price", "population").alias("annual_price"), W.weighted_mean_or_mean("direct_price", "population").alias("direct_price"), F.sum("population").alias("population"))
    both = prices.join(hours, year)
    hourly = F.try_divide(F.col("annual_price"), hours_in_year * F.nullif(F.col("mean_hours"), F.lit(0.0)))
    both = both.withColumn("hourly_price", hourly)
    bridge = F.try_divide(F.col("total_hours"), hours_in_year * F.nullif(F.col("mean_hours"), F.lit(0.0)))
    both = both.withColumn("bridge_quantity", bridge)
    return both.withColumns({
        "value_hours_method": F.col("hourly_price") * F.col("total_hours"), "value_quantity_method": F.col("annual_price") * F.col("bridge_quantity"),
        "value_direct_care": F.col("direct_price") * F.col("bridge_quantity"), "value_replacement": F.col("mean_wage") * F.col("total_hours"),
        "coverage_share": F.try_divide(F.col("bridge_quantity"), F.nullif(F.col("population"), F.lit(0.0))),
    })


def window_summary(df: DataFrame, measures: list[str], first: int, last: int, excluded: int, year: str = "year") -> DataFrame:
    """R2: mean and median over the window without the sensitivity year; over all years where the window is empty."""
    inside = F.col(year).between(first, last) & (F.col(year) != excluded)
    out = [F.count_if(inside).alias("n_window_years"), F.min(F.when(inside, F.col(year))).alias("first_year"), F.max(F.when(inside, F.col(year))).alias("last_year")]
    for m in measures:
        own = F.when(inside, F.col(m))
        out += [F.coalesce(F.avg(own), F.avg(m)).alias(f"mean_{m}"), F.coalesce(F.median(own), F.median(m)).alias(f"median_{m}")]
    return df.agg(*out)


def support_counts(df: DataFrame, status: str, keys: list[str] | None = None) -> DataFrame:
    """Rows and share of each support tier."""
    return W.value_shares(df.withColumn("support_tier", S.support_tier(status)), keys or [], "support_tier")


def readiness(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is required against what is there: ready, optional_missing or blocking."""
    rows = required.join(present.select(key).distinct().withColumn("_has", F.lit(1)), key, "left")
    status = F.when(F.col("_has") == 1, "ready").when(F.col("optional"), "optional_missing").otherwise("blocking")
    return rows.withColumns({"status": status, "priority": F.when(status == "blocking", 1).when(status == "optional_missing", 2).otherwise(3)}).drop("_has")


def schema_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(artifact, column, position, dtype, rows, non_null) of every table, one aggregate scan for each."""
    out = None
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns])
        long = counted.unpivot(["_n"], df.columns, "column_name", "non_null_rows")
        place = F.create_map(*[F.lit(x) for i, (c, t) in enumerate(df.dtypes) for x in (c, f"{i}:{t}")])
        spot = F.split(place[F.col("column_name")], ":", 2)
        one = long.select(F.lit(name).alias("artifact"), "column_name", spot[0].cast("int").alias("position"), spot[1].alias("dtype"), F.col("_n").alias("row_count"), "non_null_rows")
        out = one if out is None else out.unionByName(one)
    return out


def contract(inventory: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Grain, key role, nullability, meaning and unit of every column."""
    grain = F.create_map(*[F.lit(x) for a, ks in keys.items() for x in (a, "|".join(ks))])
    own = F.split(grain[F.col("artifact")], r"\|")
    return inventory.select(
        "artifact", "column_name", grain[F.col("artifact")].alias("grain"), F.array_contains(own, F.col("column_name")).alias("is_key"),
        (F.col("non_null_rows") < F.col("row_count")).alias("nullable"), S.semantic_type("column_name").alias("semantic_type"), S.unit_of("column_name").alias("unit"),
    )


def grouped_notes(df: DataFrame, status: str, item: str, note: str) -> DataFrame:
    """Items of each status, and their distinct notes, as sorted arrays."""
    return df.groupBy(status).agg(F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_set(note)).alias("notes"), F.count("*").alias("n"))


def assumption_table(spark: SparkSession, assumptions: dict[str, float]) -> DataFrame:
    """A configuration as rows."""
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(assumptions.items())], "name string, value double")


def compared(df: DataFrame, own: str, other: str) -> list[Column]:
    """Difference and relative difference of two columns."""
    return [(F.col(own) - F.col(other)).alias(f"{own}_delta"), F.try_divide(F.col(own) - F.col(other), F.nullif(F.col(other), F.lit(0.0))).alias(f"{own}_pct")]
