"""Weighted aggregates. Each of the five weighted means has its own name, as they differ on null values and zero weights.

All are plain aggregate expressions, so a whole column list is one pass with
partial aggregation. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted_mean_strict(value, weight) -> Column:
    """A1: all rows count; a total weight of zero is an error."""
    v, w = _c(value), _c(weight)
    return F.sum(v * w) / F.when(F.sum(w) == 0, F.raise_error(F.lit("weights sum to zero")).cast("double")).otherwise(F.sum(w))


def weighted_mean_or_mean(value, weight) -> Column:
    """A2: over rows with a value and a positive weight; else the plain mean; else null."""
    v, w = _c(value), _c(weight)
    ok = v.isNotNull() & (w > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w))), F.avg(v))


def weighted_mean_or_null(value, weight) -> Column:
    """A3: as A2 without the plain mean."""
    v, w = _c(value), _c(weight)
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def weighted_mean_nulls_zero(value, weight) -> Column:
    """A4: null values count as 0, weights below 0 as 0; without weight the mean, else 0."""
    v, w = F.coalesce(_c(value), F.lit(0.0)), F.greatest(F.coalesce(_c(weight), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(F.when(F.sum(w) > 0, F.sum(v * w) / F.sum(w)), F.avg(v), F.lit(0.0))


def quantity_price(price, quantity) -> Column:
    """A5: quantity-weighted price, 0 without quantity."""
    p, q = _c(price), _c(quantity)
    return F.coalesce(F.try_divide(F.sum(p * q), F.sum(q)), F.lit(0.0))


def ratio_of_sums(value, weight, floor: float = 1e-9) -> Column:
    """The numerator skips null values, the denominator is floored."""
    v, w = _c(value), _c(weight)
    return F.coalesce(F.sum(v * w), F.lit(0.0)) / F.greatest(F.sum(w), F.lit(floor))


def weighted_total(value, weight, factor: float = 1.0) -> Column:
    """Sum of value * weight * factor."""
    return F.sum(_c(value) * _c(weight) * factor)


def rate_of_sums(part, whole, rate) -> Column:
    """Part over whole, else the mean of the given rates."""
    return F.coalesce(F.try_divide(F.sum(_c(part)), F.nullif(F.sum(_c(whole)), F.lit(0))), F.avg(_c(rate)))


def to_groups(df: DataFrame, keys: list[str], measures: list[str], weight: str, total: str) -> DataFrame:
    """Every measure by A2, and the total weight, in one pass."""
    means = [weighted_mean_or_mean(m, weight).alias(m) for m in measures]
    return df.groupBy(*keys).agg(*means, F.sum(weight).alias(total))


def share_positive(condition: Column) -> Column:
    """A10: the share of rows where a condition holds (null: does not)."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def value_shares(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Counts of each value, and their share within keys."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))


def first_known(value, order) -> Column:
    """The first value that is not null, in the given order."""
    v, o = _c(value), _c(order)
    return F.min_by(v, F.when(v.isNotNull(), o))


def first_text(value, order, default: str = "missing") -> Column:
    """The first text that is not null, blank or the default."""
    v = F.trim(_c(value))
    ok = v.isNotNull() & (v != "") & (F.lower(v) != default)
    return F.coalesce(F.min_by(F.when(ok, v), F.when(ok, _c(order))), F.lit(default))


def joined_texts(value, sep: str = "|") -> Column:
    """Distinct non-blank texts in sorted order (order of appearance is not defined here)."""
    v = F.trim(_c(value))
    return F.array_join(F.array_sort(F.collect_set(F.when(v != "", v))), sep)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str = "weighted_median") -> DataFrame:
    """The first value whose running weight share reaches one half; the plain median without weight.

    Weights are first summed per distinct value, so the window sees no more rows than there are values.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    values = known.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    running = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    marked = values.withColumns({"_total": F.sum("_w").over(group), "_run": F.sum("_w").over(running)})
    share = F.col("_run") / F.col("_total")
    plain = known.groupBy(*keys).agg(F.median(value).alias("_plain"), F.sum(weight).alias("_all"))
    half = marked.filter((F.col("_total") > 0) & (share >= 0.5)).groupBy(*keys).agg(F.min(value).alias("_half"))
    joined = plain.join(half, keys, "left") if keys else plain.crossJoin(half)
    return joined.select(*keys, F.when(F.col("_all") > 0, F.col("_half")).otherwise(F.col("_plain")).alias(out))


def slope(y, x, least_rows: int = 2, least_distinct: int = 2) -> Column:
    """Least-squares slope, null below the stated numbers of rows and distinct x and y."""
    y, x = _c(y), _c(x)
    both = y.isNotNull() & x.isNotNull()
    x1, y1 = F.when(both, x), F.when(both, y)
    enough = (F.count(x1) >= least_rows) & (F.count_distinct(x1) >= least_distinct) & (F.count_distinct(y1) >= least_distinct)
    return F.when(enough, F.regr_slope(y, x))


def moments(columns: list[str], weight: str | None = None, prefix: str = "m") -> list[Column]:
    """Sums of w * xi * xj for all pairs, a leading constant included; one aggregate scan."""
    w = F.col(weight) if weight else F.lit(1.0)
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return [F.sum(w * names[i] * names[j]).alias(f"{prefix}_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
