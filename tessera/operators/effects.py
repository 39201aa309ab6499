"""Two-way fixed effects in closed form, and the exposure design's reduced forms and Wald ratios.

Unit effects are taken out by unit means. What is left of the period effects is a
small system a cluster: its matrix holds, for two periods, how often units have both.
It is summed up over units, solved on rows of cluster x period, and comes back as a
period effect; so any panel, balanced or not, takes two scans and no rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import supply

_ALL = "_all"


def _period_effects(rows: DataFrame, columns: list[str], unit: str, period: str, cluster: str) -> DataFrame:
    """(cluster, period, name, effect) of each column, over the rows where it is known.

    A unit's periods are an array of as many entries as there are periods, and a
    cluster's system has as many rows: both grow with the years, not with the data.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = rows.select(F.col(cluster).alias("c"), F.col(unit).alias("u"), F.col(period).alias("t"), named.alias("s")).select("c", "u", "t", "s.*").filter("v is not null")
    cells = long.groupBy("c", "name", "u", "t").agg(F.count("*").alias("d"), F.sum("v").alias("v"))
    units = cells.groupBy("c", "name", "u").agg(F.sum("d").alias("n"), F.sum("v").alias("total"), F.collect_list(F.struct("t", "d", "v")).alias("own"))
    each = units.select("c", "name", "n", "total", "own", F.explode("own").alias("x"))
    right = each.groupBy("c", "name", F.col("x.t").alias("t")).agg(F.sum(F.col("x.v") - F.col("x.d") * F.col("total") / F.col("n")).alias("right"))
    pairs = each.select("c", "name", "n", "x", F.explode("own").alias("y"))
    value = F.when(F.col("x.t") == F.col("y.t"), F.col("x.d")).otherwise(0) - F.col("x.d") * F.col("y.d") / F.col("n")
    left = pairs.groupBy("c", "name", F.col("x.t").alias("t"), F.col("y.t").alias("s")).agg(F.sum(value).alias("left"))
    system = left.groupBy("c", "name", "t").agg(F.collect_list(F.struct("s", "left")).alias("row")).join(right, ["c", "name", "t"])
    types = dict(rows.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        place = {t: i for i, t in enumerate(frame["t"])}
        a = np.zeros((len(frame), len(frame)))
        for t, row in zip(frame["t"], frame["row"]):
            for r in row:
                a[place[t], place[r["s"]]] = r["left"]
        # one direction is free, as a constant is a unit effect too
        return frame[["c", "t", "name"]].assign(effect=np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ frame["right"].to_numpy(float))

    return system.groupBy("c", "name").applyInPandas(solve, f"c {types[cluster]}, t {types[period]}, name string, effect double")


def absorbed(df: DataFrame, columns: list[str], unit: str, period: str, cluster: str | None = None) -> DataFrame:
    """``df`` with ``d_<column>``: less unit effects and period effects (those of ``cluster``, where one is given, else common ones).

    Null where the column is null; units lie in one cluster. ``df`` is read twice.
    """
    own = cluster or _ALL
    rows = df if cluster else df.withColumn(_ALL, F.lit(0))
    effects = _period_effects(rows, columns, unit, period, own)
    wide = effects.groupBy(F.col("c").alias(own), F.col("t").alias(period)).agg(*[F.max(F.when(F.col("name") == c, F.col("effect"))).alias(f"_g_{c}") for c in columns])
    out = rows.join(wide, [own, period], "left").withColumns({f"d_{c}": F.col(c) - F.col(f"_g_{c}") for c in columns})
    mean = Window.partitionBy(unit)  # a unit has a row for each period
    out = out.withColumns({f"d_{c}": F.col(f"d_{c}") - F.avg(f"d_{c}").over(mean) for c in columns})
    return out.drop(*[f"_g_{c}" for c in columns], *([] if cluster else [_ALL]))


OUTCOMES = {"price": "log_price", "provider": "log_density", "employer": "log_employer_density"}


def supply_iv_panel(design: DataFrame) -> DataFrame:
    """Rows of the exposure design with the instrument, the three logs and a positive price and density."""
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    employers = F.try_divide(F.col("establishments") * 1000.0, F.nullif(F.col("population"), F.lit(0.0)))
    rows = design.withColumn("employer_density", employers)
    rows = rows.withColumns({"log_price": log("price"), "log_density": log("density"), "log_employer_density": log("employer_density")})
    return rows.filter("instrument is not null and log_price is not null and log_density is not null")


def supply_iv(panel: DataFrame, least: float = 1e-12) -> DataFrame:
    """One row: first stage and both reduced forms with county and state-year effects, errors by state, Wald ratios, identification.

    ``panel`` (staged) has geo1, geo2, year, shock, base_year, instrument and the logs of ``OUTCOMES``.
    A panel without rows gives the status ``insufficient_overlap``.
    """
    rows = absorbed(panel.select("geo1", "geo2", "year", "instrument", *OUTCOMES.values()), ["instrument", *OUTCOMES.values()], "geo2", "year", "geo1")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(f"d_{c}").alias("y")) for k, c in OUTCOMES.items()]))
    fits = supply.clustered_slope(rows.select("geo1", F.col("d_instrument").alias("x"), each.alias("o")).select("geo1", "x", "o.*"), "y", "x", "geo1", ["outcome"])
    fields = ["beta", "se", "t", "f", "within_r2", "n_obs", "n_clusters"]
    flat = fits.agg(*[F.max(F.when(F.col("outcome") == k, F.col(f))).alias(f"{k}_{f}") for k in OUTCOMES for f in fields])
    treated = F.when(F.abs("shock") > 0, F.col("geo1"))
    facts = panel.agg(
        F.count("*").alias("n_panel"), F.count_distinct("geo2").alias("n_counties"), F.count_distinct("geo1").alias("n_states"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min("base_year").alias("first_base_year"), F.max("base_year").alias("last_base_year"),
        F.count_distinct(treated).alias("n_treated_states"), F.array_join(F.array_sort(F.collect_set(treated)), ",").alias("treated_states"),
    )
    row = facts.crossJoin(flat)
    wald = lambda k: F.when(F.abs("price_beta") > least, F.col(f"{k}_beta") / F.col("price_beta"))
    identified = (F.col("n_treated_states") > 0) & F.col("price_beta").isNotNull()
    many = F.col("n_treated_states") >= 2
    status = F.when(F.col("n_panel") == 0, "insufficient_overlap").when(identified, "ok").otherwise("insufficient_identification")
    strong = many & (F.col("price_n_clusters") >= 2) & (F.col("price_f") >= 10)
    return row.withColumns({
        "status": status, "scope": F.when(many, "many_states").otherwise("single_state_pilot"), "wald_provider": wald("provider"), "wald_employer": wald("employer"),
        "first_stage": F.when(F.coalesce(strong, F.lit(False)), "strong").otherwise("weak_or_unknown"),
    })
