"""Program capacity, threshold sweeps with the pick, price tables by alpha, promoted controls and JSON summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import eav, lookups, moments, panel, quantiles, scenario
from tessera.sources import tables

from . import base, chains, demand, models, panels


def program_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program slots of a place (a cross-section without years, known for some places) on every county-year, filled by group medians, and their share of the population."""
    slots = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("geo2"), F.when((F.col("c_acctbal") > 0) & (F.col("c_nationkey") % 5 != 2), F.col("c_acctbal") / 100).alias("slots"))
    rows = base.county(spark, sf_dir).select("geo1", "geo2", "year", "population")
    out = panel.with_share_fill(tables.staged(rows), slots, "geo2")
    return base.rounded(out.select("geo1", "geo2", "year", "slots", "slots_source", "capacity_share"), 9)


CAPACITY = f"""WITH {base.COUNTY}, r AS (SELECT geo1, geo2, year, population AS b, CASE WHEN c_acctbal > 0 AND c_nationkey % 5 <> 2 THEN c_acctbal / 100 END AS v FROM county JOIN customer ON c_custkey = geo2),
q AS (SELECT *, CASE WHEN v > 0 AND b > 0 THEN v / b END AS q FROM r),
m0 AS (SELECT geo1, year, median(q) AS m0 FROM q GROUP BY ALL), m1 AS (SELECT geo1, median(q) AS m1 FROM q GROUP BY ALL), m2 AS (SELECT year, median(q) AS m2 FROM q GROUP BY ALL), m3 AS (SELECT median(q) AS m3 FROM q),
f AS (SELECT geo1, geo2, year, b, coalesce(v, b * coalesce(m0, m1, m2, m3)) AS s, CASE WHEN v IS NOT NULL THEN 'observed' WHEN m0 IS NOT NULL THEN 'state_year' WHEN m1 IS NOT NULL THEN 'state' WHEN m2 IS NOT NULL THEN 'year' ELSE 'national' END AS l
  FROM q LEFT JOIN m0 USING (geo1, year) LEFT JOIN m1 USING (geo1) LEFT JOIN m2 USING (year) CROSS JOIN m3)
SELECT geo1, geo2, year, round(s, 9) AS slots, l AS slots_source, round(least(s / b, 1), 9) AS capacity_share FROM f"""

def _labour(spark: SparkSession, sf_dir: str, county: DataFrame | None = None) -> DataFrame:
    """The decomposed county panel with densities, benchmark wages and the labels of its labour sources."""
    rows = panel.with_benchmark_wages(panel.with_density(panels.decomposition(spark, sf_dir, county)))
    wage = F.when(F.col("wage").isNotNull(), "county_observed").otherwise("state_fallback")
    employment = F.when(F.col("establishments").isNotNull(), "employment_observed").when(F.col("nonemployers").isNotNull(), "nonemployer_proxy")
    return rows.withColumns({"wage_source": wage, "employment_source": employment})


_LABOUR = f"""{panels.DECOMPOSED}, lab AS (SELECT geo1, geo2, year, n, population, establishments, nonemployers, price, wage, {panels._DENSITY} AS density, coalesce(wage, outside) AS benchmark_wage, coalesce(outside, wage) AS specialist_wage, outside, imputed_share, observed_share,
  direct_price, direct_raw, price - direct_price AS residual_price, direct_price / nullif(price, 0) AS direct_share, CAST(coalesce(direct_raw > price, false) AS DOUBLE) AS clip, workers_per_child, direct_price * children_per_worker / (400.0 * 1.2) AS implied_wage,
  CASE WHEN wage IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS wage_observed, CASE WHEN establishments IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS employment_observed,
  CASE WHEN wage IS NOT NULL AND establishments IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS labour_observed FROM dec)"""


def support_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support metadata of every state-year, sixteen measures in one pass."""
    return base.rounded(panel.support_metadata(_labour(spark, sf_dir), ["geo1", "year"], "wage_source", "employment_source"))


SUPPORT_METADATA = f"""WITH {_LABOUR}, s AS (SELECT geo1, year, sum(population) AS population, {", ".join(f"{base.a2(m, 'population')} AS {m}" for m in panel.SUPPORT)} FROM lab GROUP BY geo1, year)
SELECT geo1, year, round(population, 6) AS population, {", ".join(f"round({m}, 6) AS {m}" for m in panel.SUPPORT)}, round(1 / nullif(workers_per_child, 0), 6) AS children_per_worker, clip > 0 AS clip_binds FROM s"""

_COUNTED = ["price", "wage", "outside", "density", "benchmark_wage", "establishments", "nonemployers", "direct_price", "direct_raw", "residual_price", "direct_share", "workers_per_child", "implied_wage", "imputed_share", "observed_share", "population"]
_STATE_COUNTED = ["price", "wage", "outside", "imputed_share", "observed_share"]


def pipeline_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of sixty-odd counts: rows, places and years of both grains, known and positive values of each measure, rows by source label, and state-years that a source has."""
    # the county panel feeds both, and the state panel is read three times
    rows = tables.staged(base.county(spark, sf_dir))
    c, s = tables.staged(_labour(spark, sf_dir, rows)), tables.staged(base.state(spark, sf_dir, rows))
    when = lambda name, cond: F.count_if(cond).alias(name)
    county = c.agg(
        *panel.coverage_counts(c, _COUNTED), F.count_distinct("geo2").alias("n_counties"), F.count_distinct("geo1").alias("n_county_states"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        when("wage_county_observed", F.col("wage_source") == "county_observed"), when("wage_state_fallback", F.col("wage_source") == "state_fallback"), when("employment_observed", F.col("employment_source") == "employment_observed"),
        when("employment_proxy", F.col("employment_source") == "nonemployer_proxy"), when("employment_missing", F.col("employment_source").isNull()), when("clip_binds", F.col("clip_binds")), when("low_imputed", F.col("imputed_share") <= 0.25),
        when("core_years", F.col("year").between(base.CORE_FIRST, base.CORE_LAST)), when("sensitivity_year", F.col("year") == base.SENSITIVITY),
    )
    names = ["n_state_rows", *[f"n_state_{m}{x}" for m in _STATE_COUNTED for x in ("", "_positive")]]
    state = s.agg(*panel.coverage_counts(s, _STATE_COUNTED)).toDF(*names)
    more = s.agg(F.count_distinct("geo1").alias("n_states"), F.count_distinct("year").alias("n_years"))
    held = lookups.coverage(s, c.filter("wage is not null"), ["geo1", "year"]).toDF("n_state_years", "n_state_years_with_wage")
    return county.crossJoin(state).crossJoin(more).crossJoin(held)


def _both(columns: list[str], prefix: str) -> str:
    return ", ".join(f"count({c}) AS {prefix}{c}, count(*) FILTER ({c} > 0) AS {prefix}{c}_positive" for c in columns)


DIAGNOSTICS = f"""WITH {_LABOUR}, st AS (SELECT geo1, year, {", ".join(f"{base.a2(m, 'population')} AS {m}" for m in _STATE_COUNTED)} FROM county GROUP BY geo1, year),
c AS (SELECT count(*) AS n_rows, {_both(_COUNTED, "n_")}, count(DISTINCT geo2) AS n_counties, count(DISTINCT geo1) AS n_county_states, min(year) AS first_year, max(year) AS last_year, count(wage) AS wage_county_observed, count(*) FILTER (wage IS NULL) AS wage_state_fallback,
  count(establishments) AS employment_observed, count(*) FILTER (establishments IS NULL AND nonemployers IS NOT NULL) AS employment_proxy, count(*) FILTER (establishments IS NULL AND nonemployers IS NULL) AS employment_missing, count(*) FILTER (clip > 0) AS clip_binds,
  count(*) FILTER (imputed_share <= 0.25) AS low_imputed, count(*) FILTER (year BETWEEN {base.CORE_FIRST} AND {base.CORE_LAST}) AS core_years, count(*) FILTER (year = {base.SENSITIVITY}) AS sensitivity_year FROM lab),
s AS (SELECT count(*) AS n_state_rows, {_both(_STATE_COUNTED, "n_state_")}, count(DISTINCT geo1) AS n_states, count(DISTINCT year) AS n_years FROM st)
SELECT c.*, s.*, (SELECT count(*) FROM st) AS n_state_years, (SELECT count(*) FROM st SEMI JOIN (SELECT DISTINCT geo1, year FROM lab WHERE wage IS NOT NULL) k USING (geo1, year)) AS n_state_years_with_wage FROM c, s"""

#: The most imputed share, and the least observed share, of the samples that are compared.
IMPUTED, OBSERVED = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50], [0.95, 0.96, 0.98, 0.99, 1.00]


def threshold_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage fits over seven limits of the imputed and five of the observed share from one moments table, with support, gates, and the best of each kind: a fit that passes, then an admissible one, then the strongest."""
    rows = tables.staged(models.demand_rows(spark, sf_dir).select("geo1", "year", "rw", "imputed_share", "observed_share", "outside", "price", "hours", "control"))
    one = lambda kind, limits, ok: [F.when(ok(F.lit(float(x))), F.struct(F.lit(kind).alias("kind"), F.lit(float(x)).alias("threshold"))) for x in limits]
    passed = [*one("imputed", IMPUTED, lambda t: F.col("imputed_share") <= t), *one("observed", OBSERVED, lambda t: F.col("observed_share") >= t)]
    rows = rows.withColumn("_s", F.explode(F.array_compact(F.array(*passed)))).select("*", "_s.*")
    keys = [("kind", "string"), ("threshold", "double")]
    names = [k for k, _ in keys]
    fits = moments.two_stage_fits(moments.moment_rows(rows, ["outside", "price", "hours", "control"], F.col("rw"), names), keys)
    facts = rows.groupBy(*names).agg(F.count_distinct("geo1").alias("n_groups"), F.count_distinct("year").alias("n_years"))
    fits = fits.join(facts, names).withColumn("passes", moments.passes_headline())
    # a kind has a row for each threshold
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("passes"), F.desc("admissible"), F.desc(F.round("first_stage_f", 6)), "threshold"))
    out = fits.withColumn("best", rank == 1).select(*names, "n_obs", "n_groups", "n_years", "first_stage_f", "price_coefficient", "elasticity_at_mean", "admissible", "sign_consistent", "passes", "best")
    return base.rounded(out, 3)


THRESHOLDS = f"""WITH RECURSIVE {models.DEMAND}, ks AS (SELECT 'imputed' AS kind, unnest({IMPUTED})::DOUBLE AS threshold UNION ALL SELECT 'observed', unnest({OBSERVED})::DOUBLE),
th AS (SELECT dem.*, kind, threshold, kind || threshold AS id FROM dem, ks WHERE CASE WHEN kind = 'imputed' THEN imputed_share <= threshold ELSE observed_share >= threshold END),
{demand.two_stage_sql("x", "th", "id", ["control"])},
f AS (SELECT id, any_value(kind) AS kind, any_value(threshold) AS threshold, count(DISTINCT geo1) AS n_groups, count(DISTINCT year) AS n_years FROM th GROUP BY id),
g AS (SELECT *, admissible AND sign_consistent AND n_obs >= 100 AND n_groups >= 15 AND n_years >= 6 AND first_stage_f >= 10 AS passes FROM x_fit JOIN f USING (id))
SELECT kind, threshold, n_obs, n_groups, n_years, round(first_stage_f, 3) AS first_stage_f, round(price_coefficient, 3) AS price_coefficient, round(elasticity_at_mean, 3) AS elasticity_at_mean, admissible, sign_consistent, passes,
  row_number() OVER (PARTITION BY kind ORDER BY passes DESC, admissible DESC, round(first_stage_f, 6) DESC, threshold) = 1 AS best FROM g"""


def price_by_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By alpha, and over all, the median price with its outer tenths, and the medians of its direct and residual part (P8's share of the base price), exact at any size."""
    dec = panels.decomposition(spark, sf_dir).groupBy("geo1", "year").agg((F.sum(F.col("direct_price") * F.col("population")) / F.sum(F.when(F.col("direct_price").isNotNull(), F.col("price") * F.col("population")))).alias("share"))
    rows = lookups.with_grid(models.scenario_inputs(spark, sf_dir), scenario.grid(spark, alpha=scenario.ALPHAS)).withColumn("price", scenario.solved()["price"])
    rows = rows.join(dec, ["geo1", "year"]).withColumns({"direct": F.col("price") * F.col("share"), "residual": F.col("price") * (1 - F.col("share"))})
    label = F.explode(F.array(F.format_string("%.2f", "alpha"), F.lit("all")))
    part = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("v")) for c in ("price", "direct", "residual")]))
    long = tables.staged(rows.select(label.alias("alpha"), "price", "direct", "residual").select("alpha", part.alias("p")).select("alpha", "p.*"))
    return base.rounded(quantiles.exact_quantiles(long, ["alpha", "part"], "v", {"lower": 0.1, "median": 0.5, "upper": 0.9}), 4)


BY_ALPHA = f"""WITH {panels.DECOMPOSED}, ds AS (SELECT geo1, year, sum(direct_price * population) / sum(price * population) FILTER (direct_price IS NOT NULL) AS share FROM dec GROUP BY geo1, year),
st AS (SELECT geo1, year, {base.a2("price", "population")} AS p0, {base.a2("imputed_share", "population")} AS i, sum(population) AS q FROM county GROUP BY geo1, year),
al AS (SELECT *, unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS alpha FROM st JOIN ds USING (geo1, year) WHERE p0 > 0 AND q > 0 AND q * i >= 0),
pr AS (SELECT *, p0 * (1 + alpha * i) ** (1 / (0.4 + 0.5 + geo1 % 4)) AS price FROM al),
lo AS (SELECT unnest([format('{{:.2f}}', alpha), 'all']) AS alpha, price, share FROM pr), pa AS (SELECT alpha, unnest(['price', 'direct', 'residual']) AS part, unnest([price, price * share, price * (1 - share)]) AS v FROM lo)
SELECT alpha, part, round(quantile_cont(v, 0.1), 4) AS lower, round(median(v), 4) AS median, round(quantile_cont(v, 0.9), 4) AS upper FROM pa WHERE v IS NOT NULL GROUP BY alpha, part"""


def promoted_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the policy controls that enough places have, one row for each place and control."""
    return base.rounded(eav.promoted(chains.policy_wide_rows(spark, sf_dir), ["geo"], chains.CONTROLS))


PROMOTED = f"""WITH {chains.POLICY_CTE}, l AS (SELECT geo, unnest({chains.CONTROLS}) AS control, unnest([{", ".join(chains.CONTROLS)}]) AS value FROM w), k AS (SELECT control FROM l GROUP BY control HAVING count(value) >= 0.75 * count(*))
SELECT geo, control, round(value, 6) AS value FROM l WHERE value IS NOT NULL AND control IN (SELECT control FROM k)"""


def json_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly summaries as JSON records with sorted keys, read back by a schema, with the length of each record's text."""
    o = base.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("customers"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("last_pending"))
    path = f"{tables.shared_dir(spark)}/{uuid.uuid4().hex}"
    tables.write_json_summary(o, path)
    back = tables.read_json_summary(spark, path, "year int, n_orders long, customers long, last_pending long, absent string")
    text = spark.read.text(path).select(F.from_json("value", "year int")["year"].alias("year"), "value")
    keys = F.array_join(F.json_object_keys("value"), ",")
    return back.join(text, "year").select("year", "n_orders", "customers", "last_pending", "absent", keys.alias("keys"))


JSON_SUMMARIES = """SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_orders, count(DISTINCT o_custkey) AS customers, max(o_orderkey) FILTER (o_orderstatus = 'P') AS last_pending, CAST(NULL AS VARCHAR) AS absent,
  'customers,' || CASE WHEN max(o_orderkey) FILTER (o_orderstatus = 'P') IS NULL THEN '' ELSE 'last_pending,' END || 'n_orders,year' AS keys FROM orders GROUP BY 1"""

REGISTERED = {
    "support_metadata": (support_metadata, SUPPORT_METADATA), "pipeline_diagnostics": (pipeline_diagnostics, DIAGNOSTICS),
    "program_capacity": (program_capacity, CAPACITY), "threshold_pick": (threshold_pick, THRESHOLDS), "price_by_alpha": (price_by_alpha, BY_ALPHA), "promoted_controls": (promoted_controls, PROMOTED), "json_summaries": (json_summaries, JSON_SUMMARIES),
}
