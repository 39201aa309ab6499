"""A linear probability model with interactions, from one row of moments.

The design is a list of named columns; the sums of all pairs of them are taken in
parts, one row of sums for each column, so that the generated code stays short
enough to be compiled whatever the number of regressors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import moments

OBSERVED = "observed"
#: Statuses with a name of their own; every other one but ``observed`` is ``other_fallback``.
LEVELS = [("national_avg_not_reported", "not_reported"), ("national_avg_nonmetro", "nonmetro")]
OTHER = "other_fallback"


def status_columns(status: str, levels: list[tuple[str, str]] = LEVELS, other: str = OTHER) -> dict[str, Column]:
    """A column for each level, and one for all but the levels and ``observed`` (null: observed)."""
    s = F.coalesce(F.col(status), F.lit(OBSERVED))
    out = {label: (s == raw).cast("double") for raw, label in levels}
    out[other] = (~s.isin(OBSERVED, *[raw for raw, _ in levels])).cast("double")
    return out


def with_design(df: DataFrame, plain: list[str], status: str, crossed: list[str], last: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the status columns and their products with ``crossed``, and the names of all regressors in order."""
    levels = status_columns(status)
    rows = df.withColumns({f"status_{k}": c for k, c in levels.items()})
    products = {f"{c}_x_{k}": F.col(c) * F.col(f"status_{k}") for c in crossed for k in levels}
    return rows.withColumns(products), [*plain, *[f"status_{k}" for k in levels], *products, *last]


def wide_moments(df: DataFrame, columns: list[str], weight: Column | None = None) -> DataFrame:
    """(place, sums): for each column (a constant first), the sums of its products with all columns."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    rows = df.select(x.alias("x"), (F.lit(1.0) if weight is None else weight).alias("w"))
    k = len(columns) + 1
    parts = rows.select("x", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place"), "w").withColumn("own", F.col("w") * F.get("x", F.col("place")))
    sums = parts.groupBy("place").agg(*[F.sum(F.col("own") * F.get("x", F.lit(j))).alias(f"s{j}") for j in range(k)])
    return sums.select("place", F.array(*[f"s{j}" for j in range(k)]).alias("sums"))


def coefficients(df: DataFrame, y: str, features: list[str], weight: Column | None = None) -> DataFrame:
    """(place, name, value): least squares of y on a constant and the features; no row where there are no data.

    Sums are taken about the columns' means, so that a column that is constant (and its
    products with a status, which repeat that status) is told from rounding: it gets 0,
    or the share of the status that the least coefficients give. ``df`` is read twice.
    """
    names, columns = ["constant", *features], [*features, y]
    # one row of as many numbers as there are columns
    means = df.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("_means"))
    about = df.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.get("_means", F.lit(i)) for i, c in enumerate(columns)})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(frame.sort_values("place")["sums"].to_numpy())
        b = moments.fitted(a, list(range(len(names))), len(names), np.array([0.0, *frame["_means"].iloc[0]]), moments.REPEATED)
        return pd.DataFrame({"place": range(len(names)), "name": names, "value": b})

    # as many rows as there are columns
    return wide_moments(about, columns, weight).crossJoin(F.broadcast(means)).groupBy().applyInPandas(solve, "place int, name string, value double")


def with_probability(df: DataFrame, fit: DataFrame, features: list[str]) -> DataFrame:
    """``predicted``: the fitted value, clipped to 0 and 1."""
    b = fit.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda r: r["value"]).alias("_b"))
    value = sum((F.get("_b", F.lit(i + 1)) * F.col(c) for i, c in enumerate(features)), F.get("_b", F.lit(0)))
    return df.crossJoin(F.broadcast(b)).withColumn("predicted", F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))).drop("_b")


def switching_summary(df: DataFrame, y: str, plain: list[str], status: str, crossed: list[str], last: list[str]) -> DataFrame:
    """One row: every coefficient, the crossed features' effects by status, fit, rows by status, mean prediction.

    Rows that lack a regressor or the outcome are left out; ``df`` should be staged, as it is read twice.
    """
    rows, features = with_design(df.dropna(subset=[y, *plain, *last]), plain, status, crossed, last)
    fit = coefficients(rows, y, features)
    done = with_probability(rows, fit, features)
    s = F.coalesce(F.col(status), F.lit(OBSERVED))
    labels = [label for _, label in LEVELS]
    error, mean = F.sum((F.col(y) - F.col("predicted")) ** 2), F.var_pop(y) * F.count("*")
    facts = done.agg(
        F.count("*").alias("n_obs"), F.when(mean == 0, 1.0).otherwise(1 - error / mean).alias("r2_in_sample"), F.avg("predicted").alias("mean_predicted"),
        F.count_if(s == OBSERVED).alias("rows_observed"), *[F.count_if(s == raw).alias(f"rows_{k}") for raw, k in LEVELS], F.count_if(F.col(f"status_{OTHER}") > 0).alias(f"rows_{OTHER}"),
    )
    wide = fit.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(f"b_{c}") for c in ["constant", *features]])
    effects = {f"effect_{c}_{OBSERVED}": F.col(f"b_{c}") for c in crossed}
    effects |= {f"effect_{c}_{k}": F.col(f"b_{c}") + F.col(f"b_{c}_x_{k}") for c in crossed for k in [*labels, OTHER]}
    return facts.crossJoin(wide).withColumns(effects)
