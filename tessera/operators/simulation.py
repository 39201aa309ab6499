"""Scenario simulations: decomposed prices, the cluster bootstrap, headline tables and diagnostics.

A draw's fits are sums over clusters, weighted by how often the draw holds each, so
a hundred draws cost one scan of the data and a small join; prices are then solved
for every row and alpha over all accepted draws together, as an array beside the row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import lookups, scenario

MARGINAL = 0.01
HOURS, FRINGE = 2080.0, 1.2


def decomposed(df: DataFrame, prices: list[str], share: str, children: str, hours: float = HOURS, fringe: float = FRINGE) -> DataFrame:
    """Direct and other part of each price, and the wage that the direct part implies."""
    part = F.least(F.greatest(F.col(share), F.lit(0.0)), F.lit(1.0))
    out = {}
    for p in prices:
        direct = F.col(p) * part
        out |= {f"{p}_direct": direct, f"{p}_other": F.greatest(F.col(p) - direct, F.lit(0.0)), f"{p}_wage": direct * F.col(children) / (hours * fringe)}
    return df.withColumns(out)


def with_marginal(df: DataFrame, **names) -> DataFrame:
    """The price at the marginal alpha beside each row's own."""
    return df.withColumn("_marginal", F.lit(MARGINAL)).withColumn("marginal_price", scenario.solved(alpha="_marginal", **names)["price"]).drop("_marginal")


def demand_moments(df: DataFrame, group: str, y: str, p: str, z: str, w: Column) -> DataFrame:
    """Sums of each cluster for a just-identified two-stage fit."""
    y, p, z = F.col(y), F.col(p), F.col(z)
    sums = {"w": w, "z": w * z, "p": w * p, "y": w * y, "zp": w * z * p, "zy": w * z * y}
    return df.groupBy(group).agg(*[F.sum(e).alias(n) for n, e in sums.items()])


def supply_moments(df: DataFrame, group: str, price: str, density: str) -> DataFrame:
    """Sums of each cluster for a pooled log-log slope."""
    x, y = F.ln(price), F.ln(density)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("v"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xv"))


def _drawn(moments: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    names = [c for c in moments.columns if c != group]
    times = scenario.draw_multiplicities(moments, group, draws, seed)
    return times.join(moments, group).groupBy("draw").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in names])


def bootstrap_fits(demand: DataFrame, supply: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """(draw, demand_elasticity, supply_elasticity, reason): both sides resampled on their own; reason is null for an accepted fit."""
    d, s = _drawn(demand, group, draws, seed), _drawn(supply, group, draws, seed + 1)
    zp, zy = F.col("zp") - F.col("z") * F.col("p") / F.col("w"), F.col("zy") - F.col("z") * F.col("y") / F.col("w")
    d = d.select("draw", (F.try_divide(zy, zp) * F.try_divide(F.col("p"), F.col("y"))).alias("signed"))
    slope = F.try_divide(F.col("xv") - F.col("x") * F.col("v") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    s = s.select("draw", slope.alias("supply_elasticity"))
    reason = F.when(F.col("signed").isNull() | (F.col("signed") > 0), "demand_fit").when(F.col("supply_elasticity").isNull() | (F.col("supply_elasticity") <= 0), "supply_fit")
    return d.join(s, "draw").select("draw", scenario.demand_magnitude(F.col("signed")).alias("demand_elasticity"), "supply_elasticity", reason.alias("reason"))


def bootstrap_prices(rows: DataFrame, fits: DataFrame, alphas: DataFrame, save, entry: str | None = None, cost: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows by alpha with ``draws`` and ``draw_prices``, arrays over the accepted draws; and the fits with their final reason.

    A row's draws are solved together where the row lies: nothing is crossed or shuffled. A draw of which one
    row has no root is rejected as a whole. ``fits`` has a row for each draw, three numbers that go with the
    task; ``save`` writes and rereads the arrays, as they are read twice.
    """
    good = [(r.draw, r.demand_elasticity, r.supply_elasticity) for r in fits.filter("reason is null").orderBy("draw").collect()]
    numbers, demand, supply = (np.array(x, float) for x in (zip(*good) if good else ([], [], [])))
    inputs = lookups.with_grid(rows.drop("demand_elasticity", "supply_elasticity"), alphas)
    names = ["base_price", "market", "unpaid", "alpha", *[c for c in (entry, cost) if c]]

    def solve(frames):
        for frame in frames:
            n, d = len(frame), len(numbers)
            x = {c: np.repeat(frame[c].to_numpy(float), d) for c in names}
            zero = np.zeros(n * d)
            es = np.tile(supply, n)
            price, _, _ = scenario._solve(x["base_price"], x["market"], x["unpaid"], x["alpha"], np.tile(demand, n), es, es, x[entry] if entry else zero, x[cost] if cost else zero)
            yield frame.assign(draw_prices=list(price.reshape(n, d)))

    form = ", ".join(f"`{c}` {t}" for c, t in inputs.dtypes) + ", draw_prices array<double>"
    solved = save(inputs.mapInPandas(solve, form))
    each = solved.select(F.posexplode("draw_prices").alias("i", "p")).groupBy("i").agg(F.bool_or(F.col("p").isNull() | F.isnan("p")).alias("lost"))
    lost = {int(numbers[r.i]) for r in each.filter("lost").collect()}
    kept = [i for i, k in enumerate(numbers.astype(int).tolist()) if k not in lost]
    at = F.lit([int(numbers[i]) for i in kept]) if kept else F.array().cast("array<int>")
    prices = F.transform(F.lit(kept) if kept else F.array().cast("array<int>"), lambda i: F.get("draw_prices", i))
    reason = F.coalesce("reason", F.when(F.col("draw").isin(*lost) if lost else F.lit(False), "solver"))
    return solved.withColumns({"draws": at, "draw_prices": prices}), fits.withColumn("reason", reason)


def _quantile(sorted_: Column, q: float) -> Column:
    """The quantile of a sorted array, between the two nearest ranks; null of an empty one."""
    place = (F.size(sorted_) - 1) * F.lit(float(q))
    low, high = F.get(sorted_, F.floor(place).cast("int")), F.get(sorted_, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def intervals(draws: DataFrame, keys: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Each row's interval over the accepted draws; without any there is no row."""
    rows = draws.filter(F.size("draw_prices") > 0).select(*keys, F.array_sort("draw_prices").alias("_p"))
    return rows.select(*keys, _quantile(F.col("_p"), low).alias("price_lower"), _quantile(F.col("_p"), high).alias("price_upper"), F.size("_p").cast("long").alias("n_draws"))


def bootstrap_record(fits: DataFrame, least_rate: float = 0.8) -> DataFrame:
    """One row: draws asked for, accepted and rejected by reason, and whether enough were accepted."""
    reasons = [F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in ("demand_fit", "supply_fit", "solver")]
    rate = F.avg(F.col("reason").isNull().cast("double"))
    return fits.agg(F.count("*").alias("requested"), F.count_if(F.col("reason").isNull()).alias("accepted"), *reasons, rate.alias("acceptance_rate"), (rate >= least_rate).alias("passed"))


def _headline(base: str, price: str) -> list[Column]:
    change = F.col(price) - F.col(base)
    return [
        F.median(price).alias("median_price"), F.median(change / F.col(base)).alias("median_change"),
        F.avg((change > 0).cast("double")).alias("share_up"), F.avg((change < 0).cast("double")).alias("share_down"),
    ]


def headline_table(rows: DataFrame, axes: list[str], base: str = "base_price", price: str = "price") -> DataFrame:
    """Medians and shares of rows that rise and fall, for each point of the axes."""
    return rows.groupBy(*axes).agg(F.count("*").alias("row_count"), F.median(base).alias("median_base"), *_headline(base, price))


def headline_intervals(draws: DataFrame, axes: list[str], base: str = "base_price", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """The headline of every draw, then its quantiles over the draws."""
    long = draws.select(*axes, base, F.explode(F.arrays_zip("draws", "draw_prices")).alias("_x")).select(*axes, base, F.col("_x.draws").alias("draw"), F.col("_x.draw_prices").alias("draw_price"))
    each = long.groupBy(*axes, "draw").agg(*_headline(base, "draw_price"))
    columns = [F.percentile(c, q).alias(f"{c}_{name}") for c in ("median_price", "median_change", "share_up", "share_down") for name, q in (("lower", low), ("upper", high))]
    return each.groupBy(*axes).agg(*columns)


def diagnostics(rows: DataFrame, geo: str, year: str) -> DataFrame:
    """One row about scenario rows with status, price, intervals and the unpaid quantity."""
    width = F.col("price_upper") - F.col("price_lower")
    at = F.col("status").isin("root_at_low", "root_at_high")
    return rows.agg(
        F.count("*").alias("scenario_rows"), F.count_distinct(geo).alias("scenario_places"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.count_if(width < 1e-6).alias("zero_width"), F.count_if(F.coalesce("unpaid", F.lit(0.0)) == 0).alias("zero_unpaid"),
        *[F.percentile(width, q).alias(f"width_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
        F.count_if((F.col("status") != "converged") & ~at).alias("not_converged"), F.count_if(at).alias("at_boundary"), F.max("widenings").alias("most_widenings"),
        F.median("base_price").alias("median_base"), F.median(F.when(F.col("alpha") == 0.5, F.col("price"))).alias("median_half"),
    )
