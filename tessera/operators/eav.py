"""Entity-attribute-value tables: melting, records, split decisions, policy controls, coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def melted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """A row per value with its text, its number and its kind; blanks are dropped. ``ids`` must hold a stable row id.

    Names and their slugs are literals, and a numeric column's number is the value itself, not its text read back.
    """
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        plain = kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")
        number = F.col(f"`{c}`").cast("double") if plain else text.try_cast("double")
        return F.struct(F.lit(c).alias("column_name"), text.alias("value_text"), number.alias("value_numeric"), F.lit(re.sub("[^a-z0-9]+", "_", c.lower()).strip("_")).alias("column_slug"))

    long = df.select(*ids, F.explode(F.array(*[one(c) for c in columns])).alias("x")).select(*ids, "x.*").filter(F.trim("value_text") != "")
    kind = F.when(F.col("value_numeric").isNotNull(), "numeric").otherwise("text")
    return long.select(*ids, "column_name", "value_text", "value_numeric", kind.alias("value_kind"), "column_slug")


def records(long: DataFrame, ids: list[str], slugs: list[str], position: str = "position") -> DataFrame:
    """First text and first number of each slug, in column order, one row per record."""
    aggregates = []
    for s in slugs:
        own = F.when(F.col("column_slug") == s, F.col(position))
        aggregates += [
            F.min_by("value_text", F.when(F.col("value_text").isNotNull(), own)).alias(f"{s}_text"),
            F.min_by("value_numeric", F.when(F.col("value_numeric").isNotNull(), own)).alias(f"{s}_number"),
        ]
    return long.groupBy(*ids).agg(*aggregates)


def metric(tokens: list[str], excluded: list[str] | None = None, position: str = "position") -> Column:
    """The number of the first column whose slug holds a token and no excluded one, as an aggregate over EAV rows."""
    hit = F.col("column_slug").rlike("|".join(tokens)) & F.col("value_numeric").isNotNull()
    if excluded:
        hit = hit & ~F.col("column_slug").rlike("|".join(excluded))
    return F.min_by("value_numeric", F.when(hit, F.col(position)))


def split_support(total, part, other, share) -> Column:
    """struct(part, other, label): explicit, complement, share of the total, partial, inconsistent or missing."""
    t, a, b, s = F.col(total), F.col(part), F.col(other), F.col(share)
    both = a.isNotNull() & b.isNotNull()
    fits = F.abs(a + b - t) <= 0.05 * F.greatest(t, F.lit(1.0))
    label = (
        F.when(both & t.isNotNull() & ~fits, "inconsistent").when(both, "explicit")
        .when(a.isNotNull() & (t >= a), "inferred_complement").when(b.isNotNull() & (t >= b), "inferred_complement")
        .when(t.isNotNull() & s.isNotNull(), "proxy_share").when(a.isNotNull() | b.isNotNull(), "partial").otherwise("missing")
    )
    first = F.coalesce(a, F.when(t >= b, t - b), F.when(b.isNull(), t * s))
    second = F.coalesce(b, F.when(t >= a, t - a), F.when(a.isNull(), t * (1 - s)))
    return F.struct(first.alias("part"), second.alias("other"), label.alias("label"))


def proxy_reliability(proxy, known) -> Column:
    """Close, moderate or large by the relative and the absolute gap; without both, unknown."""
    gap = F.abs(F.col(proxy) - F.col(known))
    ratio = F.try_divide(gap, F.nullif(F.col(known), F.lit(0.0)))
    return F.when((ratio <= 0.25) & (gap <= 25_000), "close").when((ratio <= 0.75) & (gap <= 75_000), "moderate").when(ratio.isNotNull(), "large_downgraded").otherwise("unknown")


def boundary_split(share, edge: float = 0.02) -> Column:
    """A mix within ``edge`` of 0 or 1 decides the split."""
    s = F.col(share)
    return F.when(s <= edge, "all_other").when(s >= 1 - edge, "all_part").when(s.isNotNull(), "mixed").otherwise("missing")


def best_source(df: DataFrame, keys: list[str], priority: Column, order: str) -> DataFrame:
    """The row of the best priority for each key, ties by the order column; others are labelled."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(priority, order))
    return df.withColumns({"priority": priority, "pick": F.when(n == 1, "preferred").otherwise("duplicate_nonpreferred")})


def policy_wide(df: DataFrame, keys: list[str], name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """The last value of each control, as columns, and how many controls there are."""
    last = [F.max_by(value, F.when(F.col(name) == c, F.col(order))).alias(c) for c in names]
    return df.groupBy(*keys).agg(*last, F.count_distinct(name).alias("n_controls"))


def control_coverage(wide: DataFrame, names: list[str]) -> DataFrame:
    """(control, n_known, coverage)."""
    counted = wide.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in names])
    long = counted.unpivot(["n"], names, "control", "n_known")
    return long.select("control", "n_known", (F.col("n_known") / F.col("n")).alias("coverage"))


def promoted(wide: DataFrame, keys: list[str], names: list[str], least: float = 0.75) -> DataFrame:
    """(keys, control, value) of the controls whose coverage over all places reaches the threshold, known values only.

    Which they are is a small table that is joined, so nothing is looked up on the driver.
    """
    kept = control_coverage(wide, names).filter(F.col("coverage") >= least).select("control")
    long = wide.unpivot(keys, names, "control", "value").filter("value is not null")
    return long.join(F.broadcast(kept), "control", "left_semi").select(*keys, "control", "value")
