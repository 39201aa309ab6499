"""Effective-dated policies: ranges to years, overlaps resolved, one wide row for each place and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

from . import eav

#: What a scope column holds where a policy is meant for everybody.
GENERAL = ["", "all", "any", "default", "general", "n/a"]


def is_general(scopes: list[str]) -> Column:
    """Whether every scope column (family group, provider type ...) is empty or names everybody."""
    out = F.lit(True)
    for c in scopes:
        out = out & F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin(GENERAL)
    return out


def effective_rows(df: DataFrame, start: str, end: str, sheet_year: str, scopes: list[str], first: int | None = None, last: int | None = None, year: str = "year") -> DataFrame:
    """A row for each year that a policy is in force, with ``selection_priority`` (1 where it is general).

    An open or missing end (a sentinel such as 2999) ends with the sheet's year; a range that runs
    backwards or is too long is its first year alone; years outside [first, last] do not count.
    """
    rows = df.withColumn(year, F.explode(S.effective_years(start, end, sheet_year)))
    if first is not None and last is not None:
        rows = rows.filter(F.col(year).between(first, last))
    return rows.withColumn("selection_priority", is_general(scopes).cast("int"))


def resolved(rows: DataFrame, keys: list[str], name: str, start: str, order: str) -> DataFrame:
    """Of the policies in force for one (keys, name): the general ones first, then the one that began last, then the last row; how many there were."""
    own = Window.partitionBy(*keys, name)
    n = F.row_number().over(own.orderBy(F.desc("selection_priority"), F.desc(start), F.desc(order)))
    return rows.withColumns({"_n": n, "n_overlapping": F.count("*").over(own)}).filter("_n = 1").drop("_n")


def policy_years(df: DataFrame, keys: list[str], name: str, value: str, names: list[str], start: str, end: str, sheet_year: str, scopes: list[str], order: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(keys, year, a column for each control, n_controls, n_overlaps, n_general) of effective-dated policies."""
    rows = effective_rows(df, start, end, sheet_year, scopes, first, last)
    one = resolved(rows, [*keys, "year"], name, start, order)
    wide = eav.policy_wide(one, [*keys, "year"], name, value, order, names)
    facts = one.groupBy(*keys, "year").agg(F.count_if(F.col("n_overlapping") > 1).alias("n_overlaps"), F.sum("selection_priority").alias("n_general"))
    return wide.join(facts, [*keys, "year"])
