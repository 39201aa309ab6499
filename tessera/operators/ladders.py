"""Ordered rules: the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]], passed: str = "eligible") -> Column:
    """Rules are (reason, condition that excludes); null conditions exclude."""
    out = None
    for reason, excludes in rules:
        holds = F.coalesce(excludes, F.lit(True))
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out.otherwise(passed)


def support_window(df: DataFrame, facts: DataFrame, year: str = "year") -> DataFrame:
    """Each row's place against the first and last year of the facts (a one-row table)."""
    ends = facts.agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    place = F.when(F.col(year) < F.col("_first"), "pre_support").when(F.col(year) > F.col("_last"), "nowcast").otherwise("in_support")
    return df.crossJoin(F.broadcast(ends)).withColumn("support_window", place).drop("_first", "_last")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
