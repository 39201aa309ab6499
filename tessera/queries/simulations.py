"""Scenario simulations: decomposition, cluster bootstrap, headline and diagnostics (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lookups, panel, scenario, simulation
from tessera.sources import tables

from . import base, models

DRAWS, SEED = 100, 42


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at the baseline, the marginal alpha and each alpha, cut in direct and other part, with implied wages."""
    state = base.state(spark, sf_dir).select("geo1", "year", "observed_share", (F.lit(4.0) + F.col("geo1") % 3).alias("children"))
    rows = models.scenario_inputs(spark, sf_dir).join(state, ["geo1", "year"])
    rows = lookups.with_grid(rows, scenario.grid(spark, alpha=scenario.ALPHAS)).withColumn("price", scenario.solved()["price"])
    rows = simulation.decomposed(simulation.with_marginal(rows), ["base_price", "marginal_price", "price"], "observed_share", "children")
    parts = [f"{p}{x}" for p in ("base_price", "marginal_price", "price") for x in ("", "_direct", "_other", "_wage")]
    return base.rounded(rows.select("geo1", "year", "alpha", *parts), 4)


def _parts_sql(p: str) -> str:
    d = f"{p} * least(greatest(o, 0), 1)"
    return f"round({p}, 4) AS {p}, round({d}, 4) AS {p}_direct, round(greatest({p} - {d}, 0), 4) AS {p}_other, round({d} * c / (2080 * 1.2), 4) AS {p}_wage"


DECOMPOSITION = f"""WITH {models.SCENARIO}, e AS (SELECT sa.geo1, sa.year, alpha, p0 AS base_price, p0 * (1 + 0.01 * u / q) ** (1 / (ed + es)) AS marginal_price, p0 * (1 + alpha * u / q) ** (1 / (ed + es)) AS price, s.observed_share AS o, 4 + s.geo1 % 3 AS c
  FROM sa JOIN state s ON s.geo1 = sa.geo1 AND s.year = sa.year) SELECT geo1, year, alpha, {", ".join(map(_parts_sql, ("base_price", "marginal_price", "price")))} FROM e"""


def _fits(spark: SparkSession, sf_dir: str, panel_: DataFrame) -> DataFrame:
    """``panel_``: the county panel, staged."""
    rows = models.demand_rows(spark, sf_dir, panel_).withColumn("hours", F.col("population") * F.col("imputed_share"))
    county = panel.with_density(panel_).filter("price > 0 and density > 0")
    demand = simulation.demand_moments(rows, "geo1", "hours", "price", "outside", F.col("rw"))
    return tables.staged(simulation.bootstrap_fits(demand, simulation.supply_moments(county, "geo1", "price", "density"), "geo1", DRAWS, SEED))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scenario's rows (as many as state-years) and the county panel, each computed once and staged."""
    county = tables.staged(base.county(spark, sf_dir))
    return tables.staged(models.scenario_inputs(spark, sf_dir, county)), county


def _drawn(spark: SparkSession, sf_dir: str, inputs: DataFrame, county: DataFrame) -> tuple[DataFrame, DataFrame]:
    alphas = scenario.grid(spark, alpha=scenario.ALPHAS)
    return simulation.bootstrap_prices(inputs, _fits(spark, sf_dir, county), alphas, tables.staged)


def _draws_sql(moments: str, seed: int) -> str:
    """Each draw's clusters by the same congruential rule, out of the clusters of ``moments``."""
    return f"""(SELECT draw, m.* FROM (SELECT d AS draw, (((({seed} * 7919 + d * 104729 + i * 1299709 + 12345) * 48271) % 2147483647 * 48271) % 2147483647) % (SELECT count(*) FROM {moments}) AS i FROM (SELECT row_number() OVER (ORDER BY geo1) - 1 AS i FROM {moments}), (SELECT unnest(range(0, {DRAWS})) AS d)) t
  JOIN (SELECT *, row_number() OVER (ORDER BY geo1) - 1 AS i FROM {moments}) m USING (i))"""


_DENSITY = "CASE WHEN establishments IS NOT NULL OR nonemployers IS NOT NULL THEN coalesce(establishments, 0) + coalesce(nonemployers, 0) ELSE n END / population * 1000"
FITS = f"""{models.SCENARIO}, dm AS (SELECT geo1, sum(rw) AS w, sum(rw * outside) AS z, sum(rw * price) AS p, sum(rw * h) AS y, sum(rw * outside * price) AS zp, sum(rw * outside * h) AS zy
  FROM (SELECT *, population * imputed_share AS h, CASE WHEN population > 0 THEN population ELSE 1 END AS rw FROM county WHERE outside IS NOT NULL AND price > 0 AND population IS NOT NULL) GROUP BY geo1),
sm AS (SELECT geo1, count(*) AS n, sum(x) AS x, sum(v) AS v, sum(x * x) AS xx, sum(x * v) AS xv FROM (SELECT geo1, ln(price) AS x, ln({_DENSITY}) AS v FROM county WHERE price > 0 AND {_DENSITY} > 0) GROUP BY geo1),
dd AS (SELECT draw, (sum(zy) - sum(z) * sum(y) / sum(w)) / (sum(zp) - sum(z) * sum(p) / sum(w)) * sum(p) / sum(y) AS sg FROM {_draws_sql("dm", SEED)} GROUP BY draw),
sd AS (SELECT draw, (sum(xv) - sum(x) * sum(v) / sum(n)) / (sum(xx) - sum(x) * sum(x) / sum(n)) AS se FROM {_draws_sql("sm", SEED + 1)} GROUP BY draw),
f0 AS (SELECT draw, greatest(abs(sg), 1e-6) AS fd, se, CASE WHEN sg IS NULL OR sg > 0 THEN 'demand_fit' WHEN se IS NULL OR se <= 0 THEN 'supply_fit' END AS reason FROM dd JOIN sd USING (draw)),
b0 AS (SELECT geo1, year, alpha, u, p0, draw, p0 * (1 + alpha * u / q) ** (1 / (fd + se)) AS dp FROM sa, f0 WHERE reason IS NULL),
lost AS (SELECT draw FROM b0 GROUP BY draw HAVING bool_or(dp > 128 * p0)),
fits AS (SELECT draw, fd, se, coalesce(reason, CASE WHEN draw IN (SELECT draw FROM lost) THEN 'solver' END) AS reason FROM f0),
bp AS (SELECT * FROM b0 WHERE draw NOT IN (SELECT draw FROM lost))"""


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and counties resampled, both sides refitted, every row solved again: 10-90 % intervals by row and alpha."""
    draws, _ = _drawn(spark, sf_dir, *_inputs(spark, sf_dir))
    return base.rounded(simulation.intervals(draws, ["geo1", "year", "alpha"]), 3)


INTERVALS = f"WITH {FITS} SELECT geo1, year, alpha, round(quantile_cont(dp, 0.1), 3) AS price_lower, round(quantile_cont(dp, 0.9), 3) AS price_upper, count(*) AS n_draws FROM bp GROUP BY ALL"


def bootstrap_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected draws by reason, and the gate at 80 %."""
    _, fits = _drawn(spark, sf_dir, *_inputs(spark, sf_dir))
    return base.rounded(simulation.bootstrap_record(fits))


RECORD = f"""WITH {FITS} SELECT count(*) AS requested, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason = 'demand_fit') AS rejected_demand_fit, count(*) FILTER (reason = 'supply_fit') AS rejected_supply_fit, count(*) FILTER (reason = 'solver') AS rejected_solver,
  round(count(*) FILTER (reason IS NULL) / count(*), 6) AS acceptance_rate, count(*) FILTER (reason IS NULL) / count(*) >= 0.8 AS passed FROM fits"""

KQ, KC = (0.0, 0.5, 1.0), (0.0, 0.25)


def dual_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dual-shift headline with each figure's 10-90 % interval over the bootstrap's draws."""
    inputs, county = _inputs(spark, sf_dir)
    axes = scenario.grid(spark, kq=KQ, kc=KC).withColumn("alpha", F.lit(0.5))
    own = lookups.with_grid(inputs, axes).withColumn("price", scenario.solved(entry="kq", cost="kc")["price"])
    draws, _ = simulation.bootstrap_prices(inputs, _fits(spark, sf_dir, county), axes, tables.staged, entry="kq", cost="kc")
    out = simulation.headline_table(own, ["kq", "kc"]).join(simulation.headline_intervals(draws, ["kq", "kc"]), ["kq", "kc"], "left")
    return base.rounded(out, 4)


def _head_sql(price: str) -> str:
    return f"median({price}) AS median_price, median(({price} - p0) / p0) AS median_change, avg(CAST({price} > p0 AS DOUBLE)) AS share_up, avg(CAST({price} < p0 AS DOUBLE)) AS share_down"


_HEADS = ("median_price", "median_change", "share_up", "share_down")
DUAL_HEADLINE = f"""WITH {FITS}, g AS (SELECT kq, kc FROM (SELECT unnest({list(KQ)})::DOUBLE AS kq), (SELECT unnest({list(KC)})::DOUBLE AS kc)),
own AS (SELECT kq, kc, p0, p0 * ((1 + 0.5 * u / q) * exp(-kq * 0.5) * exp(kc * 0.5 * es)) ** (1 / (ed + es)) AS p FROM sc, g), h AS (SELECT kq, kc, count(*) AS row_count, median(p0) AS median_base, {_head_sql("p")} FROM own GROUP BY ALL),
r0 AS (SELECT kq, kc, draw, p0, p0 * ((1 + 0.5 * u / q) * exp(-kq * 0.5) * exp(kc * 0.5 * se)) ** (1 / (fd + se)) AS p FROM sc, g, f0 WHERE reason IS NULL), bad AS (SELECT draw FROM r0 GROUP BY draw HAVING bool_or(p > 128 * p0)),
e AS (SELECT kq, kc, draw, {_head_sql("p")} FROM r0 WHERE draw NOT IN (SELECT draw FROM bad) GROUP BY ALL), i AS (SELECT kq, kc, {", ".join(f"round(quantile_cont({c}, {q}), 4) AS {c}_{n}" for c in _HEADS for n, q in (("lower", 0.1), ("upper", 0.9)))} FROM e GROUP BY ALL)
SELECT h.* REPLACE (round(median_base, 4) AS median_base, {", ".join(f"round({c}, 4) AS {c}" for c in _HEADS)}), i.* EXCLUDE (kq, kc) FROM h LEFT JOIN i USING (kq, kc)"""


def dual_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short-run family (fixed supply, by alpha) and the medium-run family (entry and cost shifts), with changes against the baseline."""
    inputs = models.scenario_inputs(spark, sf_dir)
    short = scenario.grid(spark, alpha=scenario.ALPHAS).select(F.lit("short_run_fixed_supply").alias("family"), "alpha", F.lit(None).cast("double").alias("kq"), F.lit(None).cast("double").alias("kc"))
    medium = scenario.grid(spark, kq=KQ, kc=KC).select(F.lit("medium_run_dual_shift").alias("family"), F.lit(0.5).alias("alpha"), "kq", "kc")
    rows = lookups.with_grid(inputs, short.unionByName(medium)).withColumns({"_q": F.coalesce("kq", F.lit(0.0)), "_c": F.coalesce("kc", F.lit(0.0))})
    rows = rows.withColumn("price", scenario.solved(entry="_q", cost="_c")["price"])
    change = F.col("price") - F.col("base_price")
    return base.rounded(rows.select("family", "geo1", "year", "alpha", "kq", "kc", "base_price", "price", change.alias("price_delta"), (change / F.col("base_price")).alias("price_change")), 4)


FAMILIES = f"""WITH {models.SCENARIO}, g AS (SELECT 'short_run_fixed_supply' AS family, unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS alpha, NULL::DOUBLE AS kq, NULL::DOUBLE AS kc UNION ALL SELECT 'medium_run_dual_shift', 0.5, kq, kc FROM (SELECT unnest({list(KQ)})::DOUBLE AS kq), (SELECT unnest({list(KC)})::DOUBLE AS kc)),
r AS (SELECT *, p0 * ((1 + alpha * u / q) * exp(-coalesce(kq, 0) * alpha) * exp(coalesce(kc, 0) * alpha * es)) ** (1 / (ed + es)) AS p FROM sc, g)
SELECT family, geo1, year, alpha, kq, kc, round(p0, 4) AS base_price, round(p, 4) AS price, round(p - p0, 4) AS price_delta, round((p - p0) / p0, 4) AS price_change FROM r"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the scenario rows, their solver and their intervals."""
    inputs, county = _inputs(spark, sf_dir)
    draws, _ = _drawn(spark, sf_dir, inputs, county)
    rows = lookups.with_grid(inputs, scenario.grid(spark, alpha=scenario.ALPHAS)).withColumn("s", scenario.solved())
    rows = rows.select("*", "s.*").join(simulation.intervals(draws, ["geo1", "year", "alpha"]), ["geo1", "year", "alpha"], "left")
    return base.rounded(simulation.diagnostics(rows, "geo1", "year").drop("most_widenings"), 3)


DIAGNOSTICS = f"""WITH {FITS}, i AS (SELECT geo1, year, alpha, quantile_cont(dp, 0.9) - quantile_cont(dp, 0.1) AS w FROM bp GROUP BY ALL),
r AS (SELECT sa.*, w, p0 * (1 + sa.alpha * u / q) ** (1 / (ed + es)) AS p FROM sa LEFT JOIN i ON i.geo1 = sa.geo1 AND i.year = sa.year AND i.alpha = sa.alpha)
SELECT count(*) AS scenario_rows, count(DISTINCT geo1) AS scenario_places, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (w < 1e-6) AS zero_width, count(*) FILTER (u = 0) AS zero_unpaid, round(quantile_cont(w, 0.1), 3) AS width_p10, round(quantile_cont(w, 0.5), 3) AS width_p50, round(quantile_cont(w, 0.9), 3) AS width_p90,
  count(*) FILTER (p > 128 * p0) AS not_converged, 0::BIGINT AS at_boundary, round(median(p0), 3) AS median_base, round(median(p) FILTER (alpha = 0.5), 3) AS median_half FROM r"""

REGISTERED = {
    "scenario_decomposition": (decomposition, DECOMPOSITION), "bootstrap_intervals": (bootstrap_intervals, INTERVALS), "bootstrap_record": (bootstrap_record, RECORD),
    "dual_shift_headline": (dual_headline, DUAL_HEADLINE), "dual_shift_families": (dual_families, FAMILIES), "scenario_diagnostics": (diagnostics, DIAGNOSTICS),
}
