"""Observed values over a panel's own, support metadata and coverage counts (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import weighted as W
from tessera.operators import lookups, panel

from . import base

KEYS = ["geo1", "year"]
CONTROLS = {"wage": "R", "outside": "A", "observed_share": "N"}


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-year values from another source: means by return flag; a state-year without such lines has none."""
    m = base.micro(spark, sf_dir)
    return m.groupBy(*KEYS).agg(*[F.avg(F.when((F.col("flag") == flag) & (F.col("weight") > 45), F.col("discount"))).alias(f"seen_{c}") for c, flag in CONTROLS.items()])


_OBSERVED = "ob AS (SELECT geo1, year, " + ", ".join(f"avg(discount) FILTER (flag = '{f}' AND weight > 45) AS seen_{c}" for c, f in CONTROLS.items()) + " FROM micro GROUP BY ALL)"


def control_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three controls of the state panel overlaid by observed ones, each with its provenance."""
    rows = base.state(spark, sf_dir).select(*KEYS, *CONTROLS).join(_observed(spark, sf_dir), KEYS, "left")
    for c in CONTROLS:
        rows = lookups.prefer_observed(rows, c, f"seen_{c}", f"{c}_source", "observed", "synthetic")
    return base.rounded(rows)


def _overlay_sql(c: str) -> str:
    return f"round(coalesce(seen_{c}, {c}), 6) AS {c}, CASE WHEN seen_{c} IS NOT NULL THEN 'observed' WHEN {c} IS NOT NULL THEN 'synthetic' ELSE 'missing' END AS {c}_source"


CONTROL_OVERLAY = f"""WITH {base.STATE}, {_OBSERVED} SELECT s.geo1, s.year, {", ".join(map(_overlay_sql, CONTROLS))} FROM state s LEFT JOIN ob ON ob.geo1 = s.geo1 AND ob.year = s.year"""


def both_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed rate laid over both grains: counties take their own, else the state's, and say which."""
    m = base.micro(spark, sf_dir)
    own = m.filter("weight > 40").groupBy("geo1", "geo2", "year").agg(F.avg("discount").alias("own_rate"))
    state = m.filter("weight > 40").groupBy(*KEYS).agg(F.avg("discount").alias("state_rate"))
    rows = base.county(spark, sf_dir).select("geo1", "geo2", "year").join(own, ["geo1", "geo2", "year"], "left").join(state, KEYS, "left")
    rows = lookups.prefer_observed(rows, "state_rate", "own_rate", "rate_source", "county", "state")
    return base.rounded(rows.withColumnRenamed("state_rate", "rate"))


BOTH_GRAINS = f"""WITH {base.COUNTY}, o AS (SELECT geo1, geo2, year, avg(discount) AS r FROM micro WHERE weight > 40 GROUP BY ALL), s AS (SELECT geo1, year, avg(discount) AS r FROM micro WHERE weight > 40 GROUP BY ALL)
SELECT c.geo1, c.geo2, c.year, round(coalesce(o.r, s.r), 6) AS rate, CASE WHEN o.r IS NOT NULL THEN 'county' WHEN s.r IS NOT NULL THEN 'state' ELSE 'missing' END AS rate_source
FROM county c LEFT JOIN o ON o.geo1 = c.geo1 AND o.geo2 = c.geo2 AND o.year = c.year LEFT JOIN s ON s.geo1 = c.geo1 AND s.year = c.year"""


def school_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index by state without a year, beside every state-year; where a state has none, one less the share."""
    c = base.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("geo1")).agg(F.try_divide(F.count_if(F.col("c_acctbal") > 9000).cast("double"), F.nullif(F.count_if(F.col("c_acctbal") > 8000), F.lit(0))).alias("option"))
    rows = base.state(spark, sf_dir).select(*KEYS, "imputed_share").join(c, "geo1", "left")
    return base.rounded(rows.select(*KEYS, F.coalesce("option", 1 - F.col("imputed_share")).alias("school_option"), F.col("option").isNull().alias("fell_back")))


SCHOOL = f"""WITH {base.STATE}, c AS (SELECT c_nationkey AS geo1, count(*) FILTER (c_acctbal > 9000) / nullif(count(*) FILTER (c_acctbal > 8000), 0) AS o FROM customer GROUP BY ALL)
SELECT s.geo1, s.year, round(coalesce(o, 1 - imputed_share), 6) AS school_option, o IS NULL AS fell_back FROM state s LEFT JOIN c ON c.geo1 = s.geo1"""

_SHARES = ("wage", "outside", "establishments", "nonemployers")


def state_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of county rows whose sources are observed, by population, with the inverse staffing ratio and whether the price clip binds."""
    rows = base.county(spark, sf_dir).withColumns({f"{c}_known": F.col(c).isNotNull().cast("double") for c in _SHARES})
    rows = rows.withColumns({"workers": (1 + F.col("geo2") % 3) / F.lit(10.0), "clip": (F.col("wage") * 40 > F.col("price")).cast("double")})
    out = W.to_groups(rows, KEYS, [*[f"{c}_known" for c in _SHARES], "imputed_share", "workers", "clip"], "population", "population")
    out = out.withColumns({"children_per_worker": F.try_divide(F.lit(1.0), F.nullif("workers", F.lit(0.0))), "clip_binds": F.col("clip") > 0})
    return base.rounded(out.drop("workers"))


STATE_SUPPORT = f"""WITH {base.COUNTY}, r AS (SELECT *, {", ".join(f"CAST({c} IS NOT NULL AS DOUBLE) AS {c}_known" for c in _SHARES)}, (1 + geo2 % 3) / 10.0 AS workers, CAST(wage * 40 > price AS DOUBLE) AS clip FROM county),
s AS (SELECT geo1, year, sum(population) AS population, {", ".join(f"{base.a2(c, 'population')} AS {c}" for c in (*[f"{c}_known" for c in _SHARES], "imputed_share", "workers", "clip"))} FROM r GROUP BY geo1, year)
SELECT geo1, year, round(population, 6) AS population, {", ".join(f"round({c}_known, 6) AS {c}_known" for c in _SHARES)}, round(imputed_share, 6) AS imputed_share, round(clip, 6) AS clip, round(1 / nullif(workers, 0), 6) AS children_per_worker, clip > 0 AS clip_binds FROM s"""

_COUNTED = ["price", "imputed_share", "observed_share", "n", "population", "wage", "outside", "establishments", "nonemployers", "density", "benchmark_wage", "replacement_cost"]


def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the county panel: rows, known and positive values of each column, places, years, and rows of each gap."""
    rows = panel.with_benchmark_wages(panel.with_density(base.county(spark, sf_dir)))
    gaps = {"both_firms": F.col("establishments").isNotNull() & F.col("nonemployers").isNotNull(), "no_wage_at_all": F.col("wage").isNull() & F.col("outside").isNull(), "core": F.col("year").between(base.CORE_FIRST, base.CORE_LAST), "mostly_imputed": F.col("imputed_share") > 0.5, "all_observed": F.col("observed_share") == 1}
    keys = [F.count_distinct("geo1").alias("n_states"), F.count_distinct("geo2").alias("n_counties"), F.min("year").alias("first_year"), F.max("year").alias("last_year")]
    return rows.agg(*panel.coverage_counts(rows, _COUNTED), *keys, *[F.count_if(g).alias(f"n_{k}") for k, g in gaps.items()])


_DENSITY = "CASE WHEN establishments IS NOT NULL OR nonemployers IS NOT NULL THEN coalesce(establishments, 0) + coalesce(nonemployers, 0) ELSE n END * 1000 / nullif(population, 0)"
PANEL_COVERAGE = f"""WITH {base.COUNTY}, r AS (SELECT *, {_DENSITY} AS density, coalesce(wage, outside) AS benchmark_wage, coalesce(wage, outside) * population AS replacement_cost FROM county)
SELECT count(*) AS n_rows, {", ".join(f"count({c}) AS n_{c}, count(*) FILTER ({c} > 0) AS n_{c}_positive" for c in _COUNTED)}, count(DISTINCT geo1) AS n_states, count(DISTINCT geo2) AS n_counties, min(year) AS first_year, max(year) AS last_year,
  count(*) FILTER (establishments IS NOT NULL AND nonemployers IS NOT NULL) AS n_both_firms, count(*) FILTER (wage IS NULL AND outside IS NULL) AS n_no_wage_at_all, count(*) FILTER (year BETWEEN {base.CORE_FIRST} AND {base.CORE_LAST}) AS n_core, count(*) FILTER (imputed_share > 0.5) AS n_mostly_imputed, count(*) FILTER (observed_share = 1) AS n_all_observed FROM r"""


REGISTERED = {
    "control_overlay": (control_overlay, CONTROL_OVERLAY), "rates_on_both_grains": (both_grains, BOTH_GRAINS), "school_options": (school_options, SCHOOL),
    "state_support": (state_support, STATE_SUPPORT), "panel_coverage": (panel_coverage, PANEL_COVERAGE),
}
