"""Equilibrium prices as a column over scenario tables.

The solver is one vectorised column: a bracket is widened and halved for all rows
of an Arrow batch together. Failures are a status, not an exception, so one odd
row does not end a job over billions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHAS = (0.0, 0.25, 0.5, 1.0)
HALVINGS, WIDENINGS, LEAST_PRICE, MOST_TIMES = 80, 12, 1e-6, 128.0
LOW_SHARE, HIGH_SHARE, HIGH_PER_ALPHA = 0.25, 1.5, 2.0
SOLVED = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("widenings", T.IntegerType())])


def quantity_demanded(price, base, market, unpaid, alpha, elasticity) -> Column:
    """Market quantity plus the share alpha of the unpaid one, iso-elastic around the base price."""
    return (F.col(market) + F.col(alpha) * F.col(unpaid)) * F.pow(F.col(price) / F.col(base), -F.col(elasticity))


def quantity_supplied(price, base, market, below, above=None) -> Column:
    """Iso-elastic, with another elasticity above the base price where given."""
    ratio = F.col(price) / F.col(base)
    e = F.col(below) if above is None else F.when(F.col(price) <= F.col(base), F.col(below)).otherwise(F.col(above))
    return F.col(market) * F.pow(ratio, e)


def _solve(base, market, unpaid, alpha, demand, below, above, entry, cost):
    """E2 for arrays: bracket, widen, halve."""
    n = len(base)
    with np.errstate(all="ignore"):
        def excess(p):
            supply = market * np.exp(entry * alpha) * (p / (base * np.exp(cost * alpha))) ** np.where(p <= base, below, above)
            return (market + alpha * unpaid) * (p / base) ** (-demand) - supply

        ok = (base > 0) & (market > 0) & np.isfinite(base + market + unpaid + alpha + demand + below + above + entry + cost)
        low, high = np.maximum(LEAST_PRICE, base * LOW_SHARE), base * (HIGH_SHARE + alpha * HIGH_PER_ALPHA)
        top = np.maximum(high, base * MOST_TIMES)
        at_low, at_high = excess(low), excess(high)
        status = np.where(~ok, "invalid_input", np.where(at_low == 0, "root_at_low", np.where(at_high == 0, "root_at_high", "converged"))).astype(object)
        widened = np.zeros(n, np.int32)
        for _ in range(WIDENINGS):
            todo = ok & (status == "converged") & (at_low * at_high >= 0)
            if not todo.any():
                break
            low = np.where(todo, np.maximum(LEAST_PRICE, low / 2), low)
            high = np.where(todo, np.minimum(high * 2, top), high)
            widened += todo
            at_low, at_high = np.where(todo, excess(low), at_low), np.where(todo, excess(high), at_high)
        status[ok & (status == "converged") & (at_low * at_high > 0)] = "unbracketed"
        a, b = low.copy(), high.copy()
        for _ in range(HALVINGS):
            mid = 0.5 * (a + b)
            up = excess(mid) > 0
            a, b = np.where(up, mid, a), np.where(up, b, mid)
        price = np.select([status == "converged", status == "root_at_low", status == "root_at_high"], [0.5 * (a + b), low, high], np.nan)
    return price, status, widened


@F.pandas_udf(SOLVED)
def _solved(base: pd.Series, market: pd.Series, unpaid: pd.Series, alpha: pd.Series, demand: pd.Series, below: pd.Series, above: pd.Series, entry: pd.Series, cost: pd.Series) -> pd.DataFrame:
    price, status, widened = _solve(*[x.to_numpy(float) for x in (base, market, unpaid, alpha, demand, below, above, entry, cost)])
    return pd.DataFrame({"price": pd.Series(price).where(~np.isnan(price), None), "status": status, "widenings": widened})


def solved(base="base_price", market="market", unpaid="unpaid", alpha="alpha", demand="demand_elasticity", below="supply_elasticity", above=None, entry=None, cost=None) -> Column:
    """struct(price, status, widenings). ``above``: piecewise supply; ``entry`` and ``cost``: dual shift."""
    zero = F.lit(0.0)
    cols = [F.col(c).cast("double") for c in (base, market, unpaid, alpha, demand, below)]
    return _solved(*cols, F.col(above or below).cast("double"), F.col(entry).cast("double") if entry else zero, F.col(cost).cast("double") if cost else zero)


def solved_natively(base="base_price", market="market", unpaid="unpaid", alpha="alpha", demand="demand_elasticity", below="supply_elasticity", halvings: int = HALVINGS) -> Column:
    """E2 as a fold over a sequence, without Python: the cross-check of the column above (no widening)."""
    p0, total = F.col(base), F.col(market) + F.col(alpha) * F.col(unpaid)
    start = F.struct(F.greatest(F.lit(LEAST_PRICE), p0 * LOW_SHARE).alias("a"), (p0 * (HIGH_SHARE + F.col(alpha) * HIGH_PER_ALPHA)).alias("b"))

    def halve(s, _):
        mid = (s["a"] + s["b"]) * 0.5
        up = total * F.pow(mid / p0, -F.col(demand)) - F.col(market) * F.pow(mid / p0, F.col(below)) > 0
        return F.struct(F.when(up, mid).otherwise(s["a"]).alias("a"), F.when(up, s["b"]).otherwise(mid).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda s: (s["a"] + s["b"]) * 0.5)


def grid(spark: SparkSession, **axes) -> DataFrame:
    """A literal product of parameter values."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(float(v),) for v in values], f"{name} double")
        out = one if out is None else out.crossJoin(one)
    return out


def prepared(df: DataFrame, base: str = "base_price", market: str = "market", unpaid: str = "unpaid") -> DataFrame:
    """Complete rows with a positive price and market and an unpaid quantity of 0 or more."""
    return df.filter((F.col(base) > 0) & (F.col(market) > 0) & (F.col(unpaid) >= 0))


def frontier(market, unpaid, elasticity, cost) -> Column:
    """The entry shift at which the price does not change."""
    return F.when(F.col(market) > 0, F.col(unpaid) / F.col(market) + F.col(elasticity) * F.col(cost))


def demand_magnitude(signed: Column) -> Column:
    """Size of an admissible (not positive) elasticity, at least 1e-6; null otherwise."""
    return F.when(signed <= 0, F.greatest(F.abs(signed), F.lit(1e-6)))


def median_columns(columns: list[str], low: float | None = None, high: float | None = None) -> list[Column]:
    """Exact medians (and outer quantiles) for an aggregate."""
    out = [F.median(c).alias(f"median_{c}") for c in columns]
    for name, q in (("low", low), ("high", high)):
        if q is not None:
            out += [F.percentile(c, q).alias(f"{name}_{c}") for c in columns]
    return out


STEPS, LOW_END, HIGH_END = 60, 0.92, 1.08


def curve_points(rows: DataFrame, keys: list[str], alphas: list[tuple[float, str]], steps: int = STEPS) -> DataFrame:
    """Per row of ``rows`` its demand and supply curve on a price grid, and the solved points.

    ``rows``: keys, base_price, market, demand_elasticity, supply_elasticity and a solved price column for each
    (alpha, column) of ``alphas``; the grid runs from a little below the base price to a little above the base
    or the price at the first of the alphas, whichever is higher. Rows: keys, kind (demand, supply, alpha),
    place, alpha, price, quantity.
    """
    p0, q0 = F.col("base_price"), F.col("market")
    low, high = p0 * LOW_END, F.greatest(F.col(alphas[0][1]), p0) * HIGH_END
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: low + i * (high - low) / float(steps - 1))
    at = lambda price, power: q0 * F.pow(price / p0, power)
    curve = rows.select("*", F.posexplode(grid).alias("place", "price"))
    kinds = F.explode(F.array(
        F.struct(F.lit("demand").alias("kind"), at(F.col("price"), -F.col("demand_elasticity")).alias("quantity")),
        F.struct(F.lit("supply").alias("kind"), at(F.col("price"), F.col("supply_elasticity")).alias("quantity")),
    ))
    lines = curve.select(*keys, "place", "price", kinds.alias("_k")).select(*keys, "_k.kind", "place", F.lit(None).cast("double").alias("alpha"), "price", "_k.quantity")
    points = F.posexplode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(c).alias("price")) for a, c in alphas]))
    solved_ = rows.select("*", points.alias("place", "_a")).select(*keys, F.lit("alpha").alias("kind"), "place", "_a.alpha", "_a.price", at(F.col("_a.price"), F.col("supply_elasticity")).alias("quantity"))
    return lines.unionByName(solved_)


def local_scenario(base: DataFrame, treated: DataFrame, elasticity: DataFrame, place: str, alphas: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Prices and quantities at each alpha of the median treated place under the local supply elasticity.

    ``base``: place, year, base_price, market, unpaid, demand_elasticity; ``treated``: places; ``elasticity``: one row with
    supply_elasticity. Only rows of treated places count, one for each place and year. An elasticity that is not positive is no
    supply curve: the rows then have a status and no price.
    """
    columns = ["base_price", "market", "unpaid", "demand_elasticity"]
    own = base.join(treated, place, "left_semi").dropDuplicates([place, "year"]).dropna(subset=columns[:3])
    middle = own.agg(*[F.median(c).alias(c) for c in columns], F.count("*").alias("n_rows"), F.count_distinct(place).alias("n_places"))
    row = middle.crossJoin(F.broadcast(elasticity.select("supply_elasticity"))).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    usable = (F.col("supply_elasticity") > 0) & (F.col("base_price") > 0) & (F.col("market") > 0) & (F.col("demand_elasticity") > 0)
    status = F.when(F.col("n_rows") == 0, "no_treated_rows").when(F.coalesce(usable, F.lit(False)), "solved").otherwise("no_supply_curve")
    price = F.when(F.col("status") == "solved", F.when(F.col("alpha") == 0, F.col("base_price")).otherwise(solved()["price"]))
    out = row.withColumn("status", status).withColumn("price", price)
    return out.withColumn("quantity", F.col("market") * F.pow(F.col("price") / F.col("base_price"), F.col("supply_elasticity")))


def draw_multiplicities(groups: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """(draw, group, times): each draw picks as many groups as there are, with replacement.

    Slots are hashed with a small congruential rule, so every engine draws alike.
    ``groups`` are the clusters of a bootstrap (states, say), never rows.
    """
    from pyspark.sql import Window

    ranked = groups.select(group).distinct().withColumn("_i", F.row_number().over(Window.orderBy(group)) - 1)
    n = ranked.agg(F.count("*").alias("_n"))
    slots = ranked.select(F.col("_i").alias("slot")).crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    x = (F.lit(seed) * 7919 + F.col("draw") * 104729 + F.col("slot") * 1299709 + 12345).cast("long")
    x = (x * 48271) % 2147483647
    x = (x * 48271) % 2147483647
    picked = slots.withColumn("_i", x % F.col("_n")).groupBy("draw", "_i").agg(F.count("*").alias("times"))
    return picked.join(F.broadcast(ranked), "_i").select("draw", group, "times")
