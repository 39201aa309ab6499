"""Supply slopes, rule shocks, two-way fixed effects and cluster-robust regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import weighted as W

DEFAULT_ELASTICITY = 0.5


def log_panel(df: DataFrame, price: str = "price", density: str = "density") -> DataFrame:
    """Rows with positive price and density, and their logs."""
    ok = df.filter((F.col(price) > 0) & (F.col(density) > 0))
    return ok.withColumns({"lp": F.ln(price), "ld": F.ln(density)})


def group_slopes(df: DataFrame, keys: list[str], weight: str, least_rows: int = 5, least_distinct: int = 3) -> DataFrame:
    """Log-log slope and total weight of each group."""
    return df.groupBy(*keys).agg(W.slope("ld", "lp", least_rows, least_distinct).alias("slope"), F.sum(weight).alias("weight"), F.count("*").alias("n"))


def elasticity_ladder(df: DataFrame, keys: list[str], year: str, weight: str) -> DataFrame:
    """One row: weighted median of positive within-group slopes, else the year-demeaned, else the pooled slope, else the default."""
    slopes = group_slopes(df, keys, weight)
    within = W.weighted_median(slopes.filter("slope > 0"), [], "slope", "weight", "within_slope")
    # W3 without a window: demeaned slopes follow from the years' sums
    by_year = df.groupBy(year).agg(F.count("*").alias("n"), F.sum("lp").alias("x"), F.sum("ld").alias("y"), F.sum(F.col("lp") * F.col("lp")).alias("xx"), F.sum(F.col("lp") * F.col("ld")).alias("xy"))
    sxy, sxx = F.sum(F.col("xy") - F.col("x") * F.col("y") / F.col("n")), F.sum(F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    demeaned = by_year.agg(F.when(sxx > 0, sxy / sxx).alias("year_demeaned_slope"))
    pooled = df.agg(F.regr_slope("ld", "lp").alias("pooled_slope"), F.count("*").alias("n_obs"))
    groups = slopes.agg(F.count("slope").alias("n_groups"), F.count_if(F.col("slope") > 0).alias("n_positive_groups"))
    row = pooled.crossJoin(demeaned).crossJoin(groups).join(within, F.lit(True), "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    method = F.when(F.col("within_slope") > 0, "within_group").when(F.col("year_demeaned_slope") > 0, "year_demeaned").when(F.col("pooled_slope") > 0, "pooled").otherwise("fallback_default")
    chosen = F.coalesce(positive("within_slope"), positive("year_demeaned_slope"), positive("pooled_slope"), F.lit(DEFAULT_ELASTICITY))
    return row.withColumns({"elasticity": chosen, "method": method})


def piecewise_slopes(df: DataFrame, keys: list[str], baseline: str, weight: str, least_rows: int = 4, least_distinct: int = 3) -> DataFrame:
    """Slopes below and above each group's baseline price, the pooled ones where a side is missing or not positive."""

    def side(below: bool):
        on = F.col("price") <= F.col(baseline) if below else F.col("price") > F.col(baseline)
        return W.slope(F.when(on, F.col("ld")), F.when(on, F.col("lp")), least_rows, least_distinct)

    groups = df.groupBy(*keys).agg(side(True).alias("below"), side(False).alias("above"), F.sum(weight).alias("weight"))
    pooled = df.agg(side(True).alias("_b"), side(False).alias("_a"))
    rows = groups.crossJoin(F.broadcast(pooled))
    fill = lambda c, p: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.col(p))
    both = (F.col("below") > 0) & (F.col("above") > 0)
    return rows.withColumns({"both_sides": F.coalesce(both, F.lit(False)), "slope_below": fill("below", "_b"), "slope_above": fill("above", "_a")}).drop("_a", "_b", "below", "above")


def rule_shocks(df: DataFrame, geo: str, year: str, rules: list[str], index: str | None = None) -> DataFrame:
    """index = mean of 1/rule over the rules that are set (unless given); shock = index less the first year's."""
    inverses = [F.when(F.col(r) > 0, 1.0 / F.col(r)) for r in rules]
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in inverses[1:]), F.when(inverses[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in inverses[1:]), F.coalesce(inverses[0], F.lit(0.0)))
    own = F.try_divide(total, F.nullif(n, F.lit(0)))
    rows = df.withColumn("index", F.coalesce(F.col(index), own) if index else own)
    first = F.first("index", ignorenulls=True).over(Window.partitionBy(geo).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("shock", F.col("index") - first)


def exposure_design(county: DataFrame, shocks: DataFrame) -> DataFrame:
    """Base-period exposure (first known employer share by county) times the state's shock; densities and logs."""
    total = F.coalesce("establishments", F.lit(0.0)) + F.coalesce("nonemployers", F.lit(0.0))
    rows = county.withColumn("share", F.when(total > 0, F.coalesce("establishments", F.lit(0.0)) / total))
    base = rows.groupBy("geo2").agg(W.first_known("share", "year").alias("exposure"), F.min("year").alias("base_year"))
    joined = rows.join(base, "geo2").join(shocks.select("geo1", "year", "shock"), ["geo1", "year"])
    return joined.withColumn("instrument", F.col("exposure") * F.col("shock"))


def demeaned(df: DataFrame, columns: list[str], key: str | list[str]) -> DataFrame:
    """Columns less their group's mean. Means are aggregated first, so a group of many rows is no one task's work; ``df`` is read twice."""
    keys = [key] if isinstance(key, str) else key
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.join(means, keys).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def clustered_slope(df: DataFrame, y: str, x: str, cluster: str, by: list[str] | None = None) -> DataFrame:
    """Slope without intercept, cluster-robust error, t, F, within R2, from per-cluster sums in one scan."""
    by = by or []
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(cluster).isNotNull())
    sums = ok.groupBy(*by, cluster).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))
    return clustered_from_sums(sums, by)


def clustered_from_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """M19 on a row per cluster with xy, xx, yy and n."""
    total = sums.groupBy(*by).agg(
        F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"), F.sum("yy").alias("syy"), F.sum("n").alias("n_obs"), F.count("*").alias("n_clusters"),
        F.sum(F.col("xy") * F.col("xy")).alias("a"), F.sum(F.col("xy") * F.col("xx")).alias("b"), F.sum(F.col("xx") * F.col("xx")).alias("c"),
    )
    fits = (F.col("n_obs") >= 3) & (F.col("sxx") > 0)
    out = total.withColumn("beta", F.when(fits, F.col("sxy") / F.col("sxx")))
    beta = F.col("beta")
    out = out.withColumn("se", F.sqrt(F.greatest(F.col("a") - 2 * beta * F.col("b") + beta * beta * F.col("c"), F.lit(0.0))) / F.nullif("sxx", F.lit(0.0)))
    out = out.withColumn("t", F.when(F.col("se") > 0, beta / F.col("se")))
    sse = F.col("syy") - 2 * beta * F.col("sxy") + beta * beta * F.col("sxx")
    return out.select(*by, "beta", "se", "t", (F.col("t") * F.col("t")).alias("f"), F.when(F.col("syy") > 0, 1 - sse / F.col("syy")).alias("within_r2"), "n_obs", "n_clusters")
