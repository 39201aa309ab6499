"""Rule grids: carry-forward, stringency index, treatment timing, event study, leave-one-out IV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import supply


def harmonised(grid: DataFrame, observed: DataFrame, keys: list[str], year: str, value: str, sign: str | None = None, carry_sign: bool = False) -> DataFrame:
    """The dense grid with values carried forward, their source year, status and signed value."""
    rows = grid.join(observed, [*keys, year], "left")
    past = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value), F.col(year).alias("y"))), ignorenulls=True).over(past)
    rows = rows.withColumn("_last", last)
    status = F.when(F.col(value).isNotNull(), "observed").when(F.col("_last").isNotNull(), "carried_forward").otherwise("missing")
    rows = rows.withColumns({"support_status": status, "harmonised": F.col(f"_last.{value}"), "reference_year": F.col("_last.y")})
    if sign:
        signs = F.last(sign, ignorenulls=True).over(past) if carry_sign else F.col(sign)
        rows = rows.withColumn("signed", F.col("harmonised") * signs)
    return rows.drop("_last")


def stringency(wide: DataFrame, columns: list[str]) -> DataFrame:
    """L4: z-scores over all rows, their mean over the known ones, and coverage."""
    means = wide.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    rows = wide.crossJoin(F.broadcast(means))
    z = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")) for c in columns]
    n = sum((x.isNotNull().cast("int") for x in z[1:]), z[0].isNotNull().cast("int"))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in z[1:]), F.coalesce(z[0], F.lit(0.0)))
    rows = rows.withColumns({"stringency": F.try_divide(total, F.nullif(n, F.lit(0))), "coverage": n / len(columns)})
    return rows.drop(*[f"_a_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def treatment_timing(shocks: DataFrame, geo: str, year: str, shock: str, least: float = 1e-9) -> DataFrame:
    """First treated year, peak absolute shock, treated years."""
    on = F.abs(F.col(shock)) > least
    return shocks.groupBy(geo).agg(F.min(F.when(on, F.col(year))).alias("first_treated"), F.max(F.abs(F.col(shock))).alias("peak"), F.count_if(on).alias("n_treated_years"), F.count("*").alias("n_years"))


def event_study(outcomes: DataFrame, timing: DataFrame, geo: str, year: str, value: str, first: int = -3, last: int = 3, reference: int = -1) -> DataFrame:
    """Per event time k, (treated - control at k) - (treated - control at the reference); controls match the treated rows' years."""
    rows = outcomes.join(timing.select(geo, "first_treated"), geo, "left").filter(F.col(value).isNotNull())
    treated = rows.filter("first_treated is not null").withColumn("k", F.col(year) - F.col("first_treated")).filter(F.col("k").between(first, last))
    controls = rows.filter("first_treated is null").groupBy(year).agg(F.sum(value).alias("c_sum"), F.count(value).alias("c_n"))
    means = treated.groupBy("k").agg(F.avg(value).alias("treated_mean"), F.count("*").alias("n_treated"))
    matched = treated.select("k", year).distinct().join(controls, year).groupBy("k").agg((F.sum("c_sum") / F.sum("c_n")).alias("control_mean"), F.sum("c_n").alias("n_control"))
    both = means.join(matched, "k", "left").withColumn("gap", F.col("treated_mean") - F.col("control_mean"))
    ref = both.filter(F.col("k") == reference).select(F.col("gap").alias("_ref"))
    return both.join(F.broadcast(ref), F.lit(True), "left").withColumn("effect", F.col("gap") - F.col("_ref")).drop("_ref")


def leave_one_out_iv(panel: DataFrame, y: str, x: str, cluster: str, year: str) -> DataFrame:
    """The clustered, year-demeaned slope with each cluster left out; ``none`` is the baseline.

    One scan sums up clusters by year; the folds work on that table, which has a
    row per cluster and year, so the facts are never copied per fold.
    """
    ok = panel.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    xc, yc = F.col(x), F.col(y)
    cells = ok.groupBy(cluster, year).agg(F.count("*").alias("n"), F.sum(xc).alias("sx"), F.sum(yc).alias("sy"), F.sum(xc * yc).alias("sxy"), F.sum(xc * xc).alias("sxx"), F.sum(yc * yc).alias("syy"))
    omitted = cells.select(F.col(cluster).cast("string").alias("omitted")).distinct().union(panel.sparkSession.createDataFrame([("none",)], "omitted string"))
    folds = cells.crossJoin(F.broadcast(omitted)).filter(F.col(cluster).cast("string") != F.col("omitted"))
    w = Window.partitionBy("omitted", year)
    folds = folds.withColumns({"mx": F.sum("sx").over(w) / F.sum("n").over(w), "my": F.sum("sy").over(w) / F.sum("n").over(w)})
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    sums = folds.groupBy("omitted", cluster).agg(
        F.sum(F.col("sxy") - mx * F.col("sy") - my * F.col("sx") + n * mx * my).alias("xy"), F.sum(F.col("sxx") - 2 * mx * F.col("sx") + n * mx * mx).alias("xx"),
        F.sum(F.col("syy") - 2 * my * F.col("sy") + n * my * my).alias("yy"), F.sum("n").alias("n"),
    )
    out = supply.clustered_from_sums(sums, ["omitted"])
    base = out.filter("omitted = 'none'").select(F.col("beta").alias("_base"))
    return out.crossJoin(F.broadcast(base)).withColumn("delta", F.col("beta") - F.col("_base")).drop("_base")
