"""Identification designs: two-way effects and the supply IV (W4, M20), and the switching model with interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import effects, panel, supply, switching
from tessera.sources import tables

from . import base, linear_sql, models, panels


def two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of log price on the instrument after county and year effects, which are taken out exactly in two scans."""
    rows = supply.exposure_design(base.county(spark, sf_dir), models.shocks(spark, sf_dir)).filter("instrument is not null").withColumn("lp", F.ln("price"))
    rows = tables.staged(rows.select("geo1", "geo2", "year", "lp", "instrument"))
    out = effects.absorbed(rows, ["lp", "instrument"], "geo2", "year")
    return base.rounded(supply.clustered_slope(out, "d_lp", "d_instrument", "geo1"))


_CLUSTERS = """t AS (SELECT {g}sum(xy) AS sxy, sum(xx) AS sxx, sum(yy) AS syy, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_clusters, sum(xy * xy) AS a, sum(xy * xx) AS b, sum(xx * xx) AS cc FROM c {group}),
fit AS (SELECT *, sqrt(greatest(a - 2 * beta * b + beta * beta * cc, 0)) / sxx AS se FROM (SELECT *, sxy / sxx AS beta FROM t))"""

TWO_WAY = f"""WITH RECURSIVE {models.EXPOSURE_CTE}, src AS (SELECT geo1, geo2, year, ln(price) AS y, instrument AS x FROM ex WHERE instrument IS NOT NULL),
{linear_sql.two_way("d", "src", ["geo1", "geo2", "year"], ["y", "x"], "geo2", "year")},
c AS (SELECT geo1, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM d GROUP BY geo1), {_CLUSTERS.format(g="", group="")}
SELECT round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS t, round((beta / se) * (beta / se), 6) AS f, round(1 - (syy - 2 * beta * sxy + beta * beta * sxx) / syy, 6) AS within_r2, n_obs, n_clusters FROM fit"""


def supply_iv(spark: SparkSession, sf_dir: str, county: DataFrame | None = None, shocks: DataFrame | None = None) -> DataFrame:
    """First stage, reduced forms of provider and employer density, Wald ratios and identification with county and state-year effects."""
    # the panel is read for the rows and for their base years
    county = tables.staged(base.county(spark, sf_dir)) if county is None else county
    design = supply.exposure_design(panel.with_density(county), models.shocks(spark, sf_dir) if shocks is None else shocks)
    rows = effects.supply_iv_panel(design).select("geo1", "geo2", "year", "shock", "base_year", "instrument", *effects.OUTCOMES.values())
    return base.rounded(effects.supply_iv(tables.staged(rows)), 4)


_FITS = ["beta", "se", "t", "f", "within_r2"]
_FLAT = ", ".join(
    [f"round(max({f}) FILTER (outcome = '{k}'), 4) AS {k}_{f}" for k in effects.OUTCOMES for f in _FITS]
    + [f"max({f}) FILTER (outcome = '{k}') AS {k}_{f}" for k in effects.OUTCOMES for f in ("n_obs", "n_clusters")]
    + [f"round(max(beta) FILTER (outcome = '{k}') / max(beta) FILTER (outcome = 'price'), 4) AS wald_{k}" for k in ("provider", "employer")]
)
SUPPLY_IV_CTES = f"""{models.EXPOSURE_CTE},
pan0 AS (SELECT ex.*, shock, {panels._DENSITY} AS density FROM ex JOIN shocks USING (geo1, year)),
pan AS (SELECT geo1, geo2, year, shock, base_year, instrument AS x, ln(price) AS price, ln(density) AS provider, CASE WHEN establishments > 0 THEN ln(establishments * 1000 / population) END AS employer
  FROM pan0 WHERE instrument IS NOT NULL AND price > 0 AND density > 0),
{linear_sql.two_way("d", "pan", ["geo1", "geo2", "year"], ["x", "price", "provider", "employer"], "geo2", "geo1, year")},
o AS (SELECT geo1, x, unnest(['price', 'provider', 'employer']) AS outcome, unnest([price, provider, employer]) AS y FROM d),
c AS (SELECT outcome, geo1, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM o WHERE y IS NOT NULL GROUP BY ALL), {_CLUSTERS.format(g="outcome, ", group="GROUP BY outcome")},
r AS (SELECT *, beta / se AS t, (beta / se) * (beta / se) AS f, 1 - (syy - 2 * beta * sxy + beta * beta * sxx) / syy AS within_r2 FROM fit)"""
SUPPLY_IV = f"""WITH RECURSIVE {SUPPLY_IV_CTES},
flat AS (SELECT {_FLAT} FROM r),
facts AS (SELECT count(*) AS n_panel, count(DISTINCT geo2) AS n_counties, count(DISTINCT geo1) AS n_states, min(year) AS first_year, max(year) AS last_year, min(base_year) AS first_base_year, max(base_year) AS last_base_year,
  count(DISTINCT geo1) FILTER (abs(shock) > 0) AS n_treated_states, array_to_string(list_sort(list(DISTINCT geo1) FILTER (abs(shock) > 0)), ',') AS treated_states FROM pan)
SELECT facts.*, flat.*, CASE WHEN n_treated_states > 0 THEN 'ok' ELSE 'insufficient_identification' END AS status, CASE WHEN n_treated_states >= 2 THEN 'many_states' ELSE 'single_state_pilot' END AS scope,
  CASE WHEN n_treated_states >= 2 AND price_n_clusters >= 2 AND price_f >= 10 THEN 'strong' ELSE 'weak_or_unknown' END AS first_stage FROM facts, flat"""

_PLAIN = ["job_cost", "income", "home_value", "storm_exposure", "precip_days", "unemployment"]
_CROSSED = ["storm_exposure", "precip_days"]
_LAST = ["storm_events", "log_damage"]


def switching_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job: whether it was done by the household, its group's cost, the household's means, and its place's weather with a match status."""
    part = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("job_group"))
    jobs = base.micro(spark, sf_dir).select("geo1", "geo2", "orderkey", "partkey", "flag", "amount").join(part, "partkey")
    cost = jobs.filter("flag <> 'R'").groupBy("job_group").agg((F.avg("amount") / 1e4).alias("job_cost"))
    homes = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("geo2"), (F.col("c_acctbal") / 1e3).alias("income"))
    orders = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), (F.col("o_totalprice") / 1e5).alias("home_value"))
    e = base.table(spark, sf_dir, "events").withColumn("geo1", F.pmod("user_id", F.lit(25)).cast("int"))
    kind = lambda k: F.col("event_type") == k
    weather = e.groupBy("geo1").agg(
        F.count_if(kind("error")).alias("storms"), F.count("*").alias("storm_events"), F.count_distinct(F.when(kind("click"), F.to_date("ts"))).alias("precip_days"),
        F.sum(F.when(kind("error"), F.col("value"))).alias("damage"), (F.count_if(kind("signup")) / F.count("*")).alias("unemployment"),
    )
    top = weather.agg(F.max("storms").alias("_m"))
    weather = weather.crossJoin(F.broadcast(top)).withColumn("storm_exposure", F.col("storms") / F.col("_m")).drop("_m")
    # a state's place in its region stands for how its weather was matched
    status = F.element_at(F.array(*map(F.lit, ["observed", "observed", "national_avg_not_reported", "national_avg_nonmetro", "county_proxy"])), F.pmod("geo1", F.lit(5)) + 1)
    rows = jobs.join(cost, "job_group").join(homes, "geo2").join(orders, "orderkey").join(weather, "geo1")
    return rows.select(
        (F.col("flag") == "R").cast("double").alias("diy"), "job_cost", "income", "home_value", "storm_exposure", (F.col("precip_days") / 100).alias("precip_days"), "unemployment",
        (F.col("storm_events") / 1e3).alias("storm_events"), F.log1p(F.coalesce("damage", F.lit(0.0))).alias("log_damage"), status.alias("status"),
    )


def switching_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear probability of doing a job oneself on 17 regressors with status and weather crossed; effects by status, fit, rows by status."""
    rows = tables.staged(switching_rows(spark, sf_dir))
    return base.rounded(switching.switching_summary(rows, "diy", _PLAIN, "status", _CROSSED, _LAST), 4)


_LABELS = [*[k for _, k in switching.LEVELS], switching.OTHER]
_FEATURES = [*_PLAIN, *[f"status_{k}" for k in _LABELS], *[f"{c}_x_{k}" for c in _CROSSED for k in _LABELS], *_LAST]
_B = {c: f"b[{i + 1}]" for i, c in enumerate(["constant", *_FEATURES])}
_EFFECTS = ", ".join(
    [f"round({v}, 4) AS b_{c}" for c, v in _B.items()]
    + [f"round({_B[c]}, 4) AS effect_{c}_observed" for c in _CROSSED]
    + [f"round({_B[c]} + {_B[f'{c}_x_{k}']}, 4) AS effect_{c}_{k}" for c in _CROSSED for k in _LABELS]
)
SWITCHING_EFFECTS = f"""WITH RECURSIVE {base.MICRO}, jobs AS (SELECT geo1, geo2, orderkey, flag, amount, p_type AS job_group FROM micro JOIN part ON partkey = p_partkey),
cost AS (SELECT job_group, avg(amount) / 1e4 AS job_cost FROM jobs WHERE flag <> 'R' GROUP BY ALL),
w0 AS (SELECT CAST(user_id % 25 AS INT) AS geo1, count(*) FILTER (event_type = 'error') AS storms, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'click') AS days, sum(value) FILTER (event_type = 'error') AS damage,
  count(*) FILTER (event_type = 'signup') / count(*) AS unemployment FROM events GROUP BY ALL),
w AS (SELECT *, storms / max(storms) OVER () AS storm_exposure FROM w0),
r0 AS (SELECT CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END AS diy, job_cost, c_acctbal / 1e3 AS income, o_totalprice / 1e5 AS home_value, storm_exposure, days / 100 AS precip_days, unemployment, events / 1e3 AS storm_events,
  ln(1 + coalesce(damage, 0)) AS log_damage, jobs.geo1 % 5 AS k FROM jobs JOIN cost USING (job_group) JOIN customer ON c_custkey = geo2 JOIN orders ON o_orderkey = orderkey JOIN w ON w.geo1 = jobs.geo1),
r1 AS (SELECT *, CAST(k = 2 AS DOUBLE) AS status_not_reported, CAST(k = 3 AS DOUBLE) AS status_nonmetro, CAST(k = 4 AS DOUBLE) AS status_other_fallback FROM r0),
r AS (SELECT *, {", ".join(f"{c} * status_{k} AS {c}_x_{k}" for c in _CROSSED for k in _LABELS)} FROM r1),
{linear_sql.moments("mm", "r", "1", [*_FEATURES, "diy"], "1")},
{linear_sql.solved("s", "mm", f"m[1:{len(_FEATURES) + 1}]")},
p AS (SELECT r.*, b, least(greatest({linear_sql.dot("b", _FEATURES)}, 0), 1) AS p FROM r, s)
SELECT count(*) AS n_obs, round(1 - sum((diy - p) ** 2) / (var_pop(diy) * count(*)), 4) AS r2_in_sample, round(avg(p), 4) AS mean_predicted, count(*) FILTER (k < 2) AS rows_observed, count(*) FILTER (k = 2) AS rows_not_reported,
  count(*) FILTER (k = 3) AS rows_nonmetro, count(*) FILTER (k = 4) AS rows_other_fallback, {_EFFECTS} FROM p GROUP BY b"""

REGISTERED = {
    "two_way_fixed_effects": (two_way, TWO_WAY), "supply_iv": (supply_iv, SUPPLY_IV), "switching_effects": (switching_effects, SWITCHING_EFFECTS),
}
