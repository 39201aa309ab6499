"""Labelled lookups: year maps, carry lookups, wildcard and bridge joins.

Year tables are small by nature (distinct years), so they are joined by broadcast
after ``distinct``; facts are never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _years(df: DataFrame, year: str, name: str) -> DataFrame:
    return df.select(F.col(year).cast("int").alias(name)).where(F.col(name).isNotNull()).distinct()


def asof_year_map(targets: DataFrame, available: DataFrame, year: str = "year") -> DataFrame:
    """(year, source_year): the latest available year up to the target, else the latest of all."""
    pairs = _years(targets, year, "year").crossJoin(F.broadcast(_years(available, year, "a")))
    return pairs.groupBy("year").agg(F.coalesce(F.max(F.when(F.col("a") <= F.col("year"), F.col("a"))), F.max("a")).alias("source_year"))


def nearest_year_map(targets: DataFrame, available: DataFrame, year: str = "year") -> DataFrame:
    """(year, source_year): the least distance, ties to the earlier."""
    pairs = _years(targets, year, "year").crossJoin(F.broadcast(_years(available, year, "a")))
    return pairs.groupBy("year").agg(F.min_by("a", F.struct(F.abs(F.col("a") - F.col("year")), "a")).alias("source_year"))


def carried_rates(targets: DataFrame, rates: DataFrame, value: str, year: str = "year") -> DataFrame:
    """(year, value, source_year, label): exact, else carried forward, else carried backward."""
    known = rates.where(F.col(value).isNotNull()).select(F.col(year).alias("a"), F.col(value).alias("v"))
    pairs = _years(targets, year, "year").join(F.broadcast(known), F.lit(True), "left")
    before = F.max(F.when(F.col("a") <= F.col("year"), F.struct("a", "v")))
    after = F.min(F.when(F.col("a") > F.col("year"), F.struct("a", "v")))
    chosen = pairs.groupBy("year").agg(F.coalesce(before, after).alias("s"))
    label = (
        F.when(F.col("s").isNull(), "missing").when(F.col("s.a") == F.col("year"), "exact")
        .when(F.col("s.a") < F.col("year"), "carry_forward").otherwise("carry_backward")
    )
    return chosen.select("year", F.col("s.v").alias(value), F.col("s.a").alias("source_year"), label.alias("rate_label"))


def wildcard_join(facts: DataFrame, segments: DataFrame, dimensions: list[str]) -> DataFrame:
    """A fact meets every segment whose dimensions are its own or ``*``. Segments come from a config and are broadcast."""
    condition = F.lit(True)
    for d in dimensions:
        condition = condition & ((segments[d] == "*") | (segments[d] == facts[d]))
    kept = [segments[c] for c in segments.columns if c not in dimensions]
    return facts.join(F.broadcast(segments), condition).select(*[facts[c] for c in facts.columns], *kept)


def through_bridge(facts: DataFrame, bridge: DataFrame, fine: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Inner join through a many-to-many bridge, then aggregation on the coarse keys."""
    return facts.join(bridge, fine).groupBy(*keys).agg(*aggregates)


def prefer_observed(df: DataFrame, own: str, observed: str, label: str, observed_name: str = "observed", own_name: str = "own") -> DataFrame:
    """The observed value where there is one, else the own, and which it was."""
    which = F.when(F.col(observed).isNotNull(), observed_name).when(F.col(own).isNotNull(), own_name).otherwise("missing")
    return df.withColumns({label: which, own: F.coalesce(observed, own)}).drop(observed)


def with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every point of a parameter grid (a literal table, hence broadcast)."""
    return df.crossJoin(F.broadcast(grid))


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of ``left``, and how many of them ``right`` has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct().withColumn("_has", F.lit(1))
    return a.join(b, keys, "left").agg(F.count("*").alias("n_keys"), F.count("_has").alias("n_covered"))


def dense_grid(dimensions: list[DataFrame]) -> DataFrame:
    """The product of small dimension tables; the first may be long, the others are broadcast."""
    grid = dimensions[0]
    for d in dimensions[1:]:
        grid = grid.crossJoin(F.broadcast(d))
    return grid
