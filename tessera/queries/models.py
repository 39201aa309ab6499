"""Estimators, supply, scenarios and bootstrap (M and E families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import lookups, moments, panel, rules, scenario, supply
from tessera.sources import tables

from . import base, panels


def supply_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.log_panel(panel.with_density(base.county(spark, sf_dir)))


SUPPLY = f"""{base.COUNTY}, sup0 AS (SELECT *, {panels._DENSITY} AS density FROM county),
sup AS (SELECT *, ln(price) AS lp, ln(density) AS ld FROM sup0 WHERE price > 0 AND density > 0)"""


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-log supply slope of each state-year with its guards."""
    return base.rounded(supply.group_slopes(supply_panel(spark, sf_dir), ["geo1", "year"], "population"))


_SLOPE = "CASE WHEN count(*) >= 5 AND count(DISTINCT lp) >= 3 AND count(DISTINCT ld) >= 3 THEN regr_slope(ld, lp) END"
SLOPES = f"WITH {SUPPLY} SELECT geo1, year, round({_SLOPE}, 6) AS slope, round(sum(population), 6) AS weight, count(*) AS n FROM sup GROUP BY ALL"


def elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elasticity ladder with its method."""
    return base.rounded(supply.elasticity_ladder(supply_panel(spark, sf_dir), ["geo1", "year"], "year", "population"))


ELASTICITY = f"""WITH {SUPPLY}, s AS (SELECT {_SLOPE} AS slope, sum(population) AS w FROM sup GROUP BY geo1, year),
pos AS (SELECT slope, sum(w) AS w FROM s WHERE slope > 0 GROUP BY slope),
r AS (SELECT slope, sum(w) OVER (ORDER BY slope ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS q FROM pos),
wi AS (SELECT min(slope) AS v FROM r WHERE q >= 0.5),
d AS (SELECT lp - avg(lp) OVER (PARTITION BY year) AS x, ld - avg(ld) OVER (PARTITION BY year) AS y FROM sup),
dm AS (SELECT sum(x * y) / nullif(sum(x * x), 0) AS v FROM d), po AS (SELECT regr_slope(ld, lp) AS v, count(*) AS n FROM sup), g AS (SELECT count(slope) AS n, count(*) FILTER (slope > 0) AS p FROM s)
SELECT round(po.v, 6) AS pooled_slope, po.n AS n_obs, round(dm.v, 6) AS year_demeaned_slope, g.n AS n_groups, g.p AS n_positive_groups, round(wi.v, 6) AS within_slope,
  round(CASE WHEN wi.v > 0 THEN wi.v WHEN dm.v > 0 THEN dm.v WHEN po.v > 0 THEN po.v ELSE 0.5 END, 6) AS elasticity,
  CASE WHEN wi.v > 0 THEN 'within_group' WHEN dm.v > 0 THEN 'year_demeaned' WHEN po.v > 0 THEN 'pooled' ELSE 'fallback_default' END AS method FROM po, dm, g, wi"""


def piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes below and above each state's median price, pooled where a side is missing or not positive."""
    rows = supply_panel(spark, sf_dir)
    medians = rows.groupBy("geo1").agg(F.median("price").alias("baseline"))
    return base.rounded(supply.piecewise_slopes(rows.join(medians, "geo1"), ["geo1"], "baseline", "population"))


def _side(op: str) -> str:
    on = f"price {op} baseline"
    return f"CASE WHEN count(*) FILTER ({on}) >= 4 AND count(DISTINCT lp) FILTER ({on}) >= 3 AND count(DISTINCT ld) FILTER ({on}) >= 3 THEN regr_slope(ld, lp) FILTER ({on}) END"


PIECEWISE = f"""WITH {SUPPLY}, m AS (SELECT geo1, median(price) AS baseline FROM sup GROUP BY geo1), j AS (SELECT * FROM sup JOIN m USING (geo1)),
g AS (SELECT geo1, {_side("<=")} AS b, {_side(">")} AS a, sum(population) AS weight FROM j GROUP BY geo1), p AS (SELECT {_side("<=")} AS b, {_side(">")} AS a FROM j)
SELECT geo1, round(weight, 6) AS weight, coalesce(g.b > 0 AND g.a > 0, false) AS both_sides, round(CASE WHEN g.b > 0 THEN g.b ELSE p.b END, 6) AS slope_below, round(CASE WHEN g.a > 0 THEN g.a ELSE p.a END, 6) AS slope_above FROM g, p"""


def shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of inverse rules by state-year and its shock against the first year."""
    m = base.micro(spark, sf_dir)
    r = m.groupBy("geo1", "year").agg(F.avg(F.when(F.col("line") == 1, F.col("weight"))).alias("r1"), F.avg(F.when(F.col("line") == 2, F.col("weight"))).alias("r2"), F.max(F.when(F.col("line") == 7, F.col("weight"))).alias("r3"))
    r = r.withColumn("r3", F.when(F.col("geo1") % 3 != 0, F.col("r3")))
    return supply.rule_shocks(r, "geo1", "year", ["r1", "r2", "r3"])


SHOCK = """shock0 AS (SELECT geo1, year, avg(weight) FILTER (line = 1) AS r1, avg(weight) FILTER (line = 2) AS r2, CASE WHEN geo1 % 3 <> 0 THEN max(weight) FILTER (line = 7) END AS r3 FROM micro GROUP BY geo1, year),
shock1 AS (SELECT *, list_avg(list_filter([1 / r1, 1 / r2, 1 / r3], lambda x: x IS NOT NULL)) AS index FROM shock0),
shocks AS (SELECT *, index - first_value(index IGNORE NULLS) OVER (PARTITION BY geo1 ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shock FROM shock1)"""


def rule_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 as a table."""
    return base.rounded(shocks(spark, sf_dir).select("geo1", "year", "index", "shock"))


RULE_SHOCKS = f"WITH {base.MICRO}, {SHOCK} SELECT geo1, year, round(index, 6) AS index, round(shock, 6) AS shock FROM shocks"


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-period exposure times the state's shock."""
    out = supply.exposure_design(panel.with_density(base.county(spark, sf_dir)), shocks(spark, sf_dir))
    return base.rounded(out.select("geo1", "geo2", "year", "exposure", "base_year", "instrument"))


EXPOSURE_CTE = f"""{base.COUNTY}, {SHOCK},
ex0 AS (SELECT *, CASE WHEN coalesce(establishments, 0) + coalesce(nonemployers, 0) > 0 THEN coalesce(establishments, 0) / (coalesce(establishments, 0) + coalesce(nonemployers, 0)) END AS share FROM county),
exb AS (SELECT geo2, arg_min(share, year) FILTER (share IS NOT NULL) AS exposure, min(year) AS base_year FROM ex0 GROUP BY geo2),
ex AS (SELECT c.*, exposure, base_year, exposure * shock AS instrument FROM ex0 c JOIN exb USING (geo2) JOIN shocks s ON s.geo1 = c.geo1 AND s.year = c.year)"""
EXPOSURE = f"WITH {EXPOSURE_CTE} SELECT geo1, geo2, year, round(exposure, 6) AS exposure, base_year, round(instrument, 6) AS instrument FROM ex"


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-demeaned log price on the instrument, errors clustered by state, with strength tiers."""
    rows = supply.exposure_design(base.county(spark, sf_dir), shocks(spark, sf_dir)).filter("instrument is not null").withColumn("lp", F.ln("price"))
    rows = supply.demeaned(tables.staged(rows.select("geo1", "year", "lp", "instrument")), ["lp", "instrument"], "year")
    out = supply.clustered_slope(rows, "lp", "instrument", "geo1")
    return base.rounded(out.withColumns({"strength": S.first_stage_tier("f"), "use": S.use_tier("f", "n_clusters", "n_clusters")}))


def _clustered_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    p = f"PARTITION BY {g}year"
    group = f"GROUP BY {by}" if by else ""
    return f"""d AS (SELECT {g}geo1, lp - avg(lp) OVER ({p}) AS y, instrument - avg(instrument) OVER ({p}) AS x FROM src),
c AS (SELECT {g}geo1, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM d GROUP BY {g}geo1),
t AS (SELECT {g}sum(xy) AS sxy, sum(xx) AS sxx, sum(yy) AS syy, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_clusters, sum(xy * xy) AS a, sum(xy * xx) AS b, sum(xx * xx) AS cc FROM c {group}),
b AS (SELECT *, sxy / sxx AS beta FROM t), e AS (SELECT *, sqrt(greatest(a - 2 * beta * b + beta * beta * cc, 0)) / sxx AS se FROM b)"""


CLUSTERED = f"""WITH {EXPOSURE_CTE}, src AS (SELECT geo1, year, ln(price) AS lp, instrument FROM ex WHERE instrument IS NOT NULL), {_clustered_sql()}
SELECT round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS t, round((beta / se) * (beta / se), 6) AS f, round(1 - (syy - 2 * beta * sxy + beta * beta * sxx) / syy, 6) AS within_r2, n_obs, n_clusters,
  CASE WHEN (beta / se) ** 2 >= 10 THEN 'strong' WHEN (beta / se) ** 2 >= 5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN (beta / se) ** 2 >= 10 AND n_clusters >= 5 AND n_clusters >= 30 THEN 'headline' WHEN (beta / se) ** 2 >= 5 AND n_clusters >= 3 THEN 'supporting' ELSE 'diagnostic' END AS use FROM e"""


def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustered slope with each state left out."""
    rows = supply.exposure_design(base.county(spark, sf_dir), shocks(spark, sf_dir)).filter("instrument is not null").withColumn("lp", F.ln("price"))
    return base.rounded(rules.leave_one_out_iv(rows, "lp", "instrument", "geo1", "year").select("omitted", "beta", "n_obs", "n_clusters", "delta"))


LEFT_OUT = f"""WITH {EXPOSURE_CTE}, s0 AS (SELECT geo1, year, ln(price) AS lp, instrument FROM ex WHERE instrument IS NOT NULL),
o AS (SELECT DISTINCT CAST(geo1 AS VARCHAR) AS omitted FROM s0 UNION ALL SELECT 'none'), src AS (SELECT o.omitted, s0.* FROM s0, o WHERE CAST(geo1 AS VARCHAR) <> omitted), {_clustered_sql("omitted")}
SELECT omitted, round(beta, 6) AS beta, n_obs, n_clusters, round(beta - (SELECT beta FROM e WHERE omitted = 'none'), 6) AS delta FROM e"""


def _specified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supply.exposure_design(base.county(spark, sf_dir), shocks(spark, sf_dir)).filter("instrument is not null").withColumn("lp", F.ln("price"))
    core = F.col("year").between(base.CORE_FIRST, base.CORE_LAST) & (F.col("year") != base.SENSITIVITY)
    specs = F.array_compact(F.array(F.lit("all_years"), F.when(core, "core_years"), F.when(F.col("imputed_share") <= 0.25, "low_imputed")))
    rows = tables.staged(rows.withColumn("spec", F.explode(specs)).select("spec", "geo1", "year", "lp", "instrument"))
    out = supply.clustered_slope(supply.demeaned(rows, ["lp", "instrument"], ["spec", "year"]), "lp", "instrument", "geo1", ["spec"])
    return out.withColumns({"strength": S.first_stage_tier("f"), "use": S.use_tier("f", "n_clusters", "n_clusters")})


def iv_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustered fit of each specification, its strength and what it may be used for."""
    return base.rounded(_specified(spark, sf_dir))


_TIERS = """CASE WHEN (beta / se) ** 2 >= 10 THEN 'strong' WHEN (beta / se) ** 2 >= 5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN (beta / se) ** 2 >= 10 AND n_clusters >= 5 AND n_clusters >= 30 THEN 'headline' WHEN (beta / se) ** 2 >= 5 AND n_clusters >= 3 THEN 'supporting' ELSE 'diagnostic' END AS use"""
_SPECS = f"""{EXPOSURE_CTE}, src AS (SELECT spec, geo1, year, ln(price) AS lp, instrument FROM (SELECT *, unnest(list_filter(['all_years', CASE WHEN year BETWEEN {base.CORE_FIRST} AND {base.CORE_LAST} AND year <> {base.SENSITIVITY} THEN 'core_years' END, CASE WHEN imputed_share <= 0.25 THEN 'low_imputed' END], lambda x: x IS NOT NULL)) AS spec FROM ex WHERE instrument IS NOT NULL)), {_clustered_sql("spec")}"""
IV_RESULTS = f"""WITH {_SPECS} SELECT spec, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS t, round((beta / se) * (beta / se), 6) AS f, round(1 - (syy - 2 * beta * sxy + beta * beta * sxx) / syy, 6) AS within_r2, n_obs, n_clusters, {_TIERS} FROM e"""


def iv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications by use, with the strongest first-stage F of each."""
    return base.rounded(_specified(spark, sf_dir).groupBy("use").agg(F.count("*").alias("n_specs"), F.max("f").alias("best_f"), F.max("n_clusters").alias("most_clusters")))


IV_SUMMARY = f"""WITH {_SPECS}, r AS (SELECT (beta / se) * (beta / se) AS f, n_clusters, {_TIERS} FROM e) SELECT use, count(*) AS n_specs, round(max(f), 6) AS best_f, max(n_clusters) AS most_clusters FROM r GROUP BY use"""


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3: the price surface on wage and outside option, the last year held out: errors on both sides."""
    rows = base.county(spark, sf_dir).select("geo2", "year", "price", "wage", "outside", "population")
    return base.rounded(moments.surface_quality(moments.price_surface(rows, "price", ["wage", "outside"], F.col("population"), "year"), "price"), 3)


SURFACE = f"""WITH {base.COUNTY}, d AS (SELECT year, price AS y, wage AS a, outside AS b, population AS w, year = max(year) OVER () AS h FROM county WHERE wage IS NOT NULL AND outside IS NOT NULL AND price IS NOT NULL),
s AS (SELECT sum(w) AS w, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM d WHERE NOT h),
c AS (SELECT any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum(d.w * (a - ma) * (a - ma)) AS aa, sum(d.w * (a - ma) * (b - mb)) AS ab, sum(d.w * (b - mb) * (b - mb)) AS bb, sum(d.w * (a - ma) * (y - my)) AS ay, sum(d.w * (b - mb) * (y - my)) AS by_ FROM d, s WHERE NOT h),
k AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM c), p AS (SELECT h, y, my + b1 * (a - ma) + b2 * (b - mb) AS p FROM d, k)
SELECT count(*) AS n_obs, round(sqrt(avg((y - p) ** 2) FILTER (NOT h)), 3) AS rmse_train, round(1 - sum((y - p) ** 2) FILTER (NOT h) / (var_pop(y) FILTER (NOT h) * count(*) FILTER (NOT h)), 3) AS r2_train,
  round(sqrt(avg((y - p) ** 2) FILTER (h)), 3) AS rmse_test, round(1 - sum((y - p) ** 2) FILTER (h) / (var_pop(y) FILTER (h) * count(*) FILTER (h)), 3) AS r2_test FROM p"""


def demand_rows(spark: SparkSession, sf_dir: str, county: DataFrame | None = None) -> DataFrame:
    rows = (base.county(spark, sf_dir) if county is None else county).withColumns({"hours": F.col("population"), "control": F.col("n").cast("double")})
    return moments.complete(rows, ["outside", "price", "hours"], "price").withColumn("rw", moments.regression_weight("population"))


DEMAND = f"""{base.COUNTY}, dem AS (SELECT *, population AS hours, CAST(n AS DOUBLE) AS control, CASE WHEN population > 0 THEN population ELSE 1 END AS rw FROM county WHERE outside IS NOT NULL AND price > 0 AND population IS NOT NULL)"""


def weighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted least squares of price on the outside option by year, closed form on sums."""
    rows = demand_rows(spark, sf_dir)
    return base.rounded(rows.groupBy("year").agg(*moments.weighted_slope("price", "outside", F.col("rw"))))


WEIGHTED_FIT = f"""WITH {DEMAND}, s AS (SELECT year, count(*) AS n, sum(rw) AS w, sum(rw * outside) AS x, sum(rw * price) AS y, sum(rw * outside * outside) AS xx, sum(rw * outside * price) AS xy, sum(rw * price * price) AS yy FROM dem GROUP BY year),
b AS (SELECT *, (xy - x * y / w) / (xx - x * x / w) AS slope FROM s)
SELECT year, n, round(slope, 6) AS slope, round(y / w - slope * x / w, 6) AS intercept, round(slope * (xy - x * y / w) / (yy - y * y / w), 6) AS r2 FROM b"""


def instrumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage least squares by imputation threshold; rows are exploded to the thresholds they pass, so all are one scan."""
    rows = demand_rows(spark, sf_dir)
    limits = F.array(*[F.lit(x) for x in (0.0, 0.1, 0.25, 0.5, 1.0)])
    rows = rows.withColumn("threshold", F.explode(F.filter(limits, lambda t: F.col("imputed_share") <= t)))
    return base.rounded(rows.groupBy("threshold").agg(*moments.just_identified("hours", "price", "outside", F.col("rw"))), 4)


INSTRUMENTED = f"""WITH {DEMAND}, th AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 1.0])::DOUBLE AS threshold), r AS (SELECT * FROM dem, th WHERE imputed_share <= threshold),
s AS (SELECT threshold, count(*) AS n, sum(rw) AS w, sum(rw * outside) AS z, sum(rw * price) AS p, sum(rw * hours) AS y, sum(rw * outside * price) AS zp, sum(rw * outside * hours) AS zy, sum(rw * outside * outside) AS zz, sum(rw * price * price) AS pp FROM r GROUP BY threshold),
c AS (SELECT threshold, n, p, y, zp - z * p / w AS zp, zy - z * y / w AS zy, zz - z * z / w AS zz, pp - p * p / w AS pp FROM s)
SELECT threshold, n, round(zp / zz, 4) AS first_stage, round((zp / zz) * (zp / zz) * zz * (n - 2) / (pp - zp / zz * zp), 4) AS first_stage_f, round(zy / zp, 4) AS price_coefficient, round(zy / zp * p / y, 4) AS elasticity_at_mean FROM c"""


def switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do-it-yourself share by job group and year, the saturated linear probability model, clipped to [0, 1]."""
    m = base.micro(spark, sf_dir)
    out = m.groupBy("age", "channel").agg(F.avg((F.col("flag") == "R").cast("double")).alias("p"), F.count("*").alias("n"))
    return base.rounded(out.withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))))


SWITCHING = f"WITH {base.MICRO} SELECT age, channel, round(avg(CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS p, count(*) AS n FROM micro GROUP BY ALL"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First principal component and equal-weight index of state-year measures."""
    s = tables.staged(base.state(spark, sf_dir))  # read four times, and small
    pc = moments.principal_component(s, ["price", "imputed_share", "outside"], ["geo1", "year"])
    z = rules.stringency(s, ["price", "imputed_share", "outside"]).select("geo1", "year", "stringency", "coverage")
    return base.rounded(pc.join(z, ["geo1", "year"]))


def stringency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: z-score index with coverage."""
    return base.rounded(rules.stringency(base.state(spark, sf_dir), ["price", "imputed_share", "outside"]).select("geo1", "year", "stringency", "coverage"))


_Z = [f"(({c}) - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in ("price", "imputed_share", "outside")]
STRINGENCY = f"""WITH {base.STATE}, z AS (SELECT geo1, year, list_filter([{", ".join(_Z)}], lambda x: x IS NOT NULL) AS z FROM state)
SELECT geo1, year, round(list_avg(z), 6) AS stringency, round(len(z) / 3, 6) AS coverage FROM z"""


def scenario_inputs(spark: SparkSession, sf_dir: str, county: DataFrame | None = None) -> DataFrame:
    s = base.state(spark, sf_dir, county)
    rows = s.select("geo1", "year", F.col("price").alias("base_price"), F.col("population").alias("market"), (F.col("population") * F.col("imputed_share")).alias("unpaid"), F.lit(0.4).alias("demand_elasticity"), (0.5 + F.col("geo1") % 4).alias("supply_elasticity"))
    return scenario.prepared(rows)


SCENARIO = f"""{base.STATE}, sc AS (SELECT geo1, year, price AS p0, population AS q, population * imputed_share AS u, 0.4 AS ed, 0.5 + geo1 % 4 AS es FROM state WHERE price > 0 AND population > 0 AND population * imputed_share >= 0),
sa AS (SELECT *, unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS alpha FROM sc)"""


def equilibrium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solved prices over the alpha grid with status (and the same by the native fold)."""
    rows = lookups.with_grid(scenario_inputs(spark, sf_dir), scenario.grid(spark, alpha=scenario.ALPHAS))
    out = rows.withColumn("s", scenario.solved()).withColumn("native", scenario.solved_natively())
    q = scenario.quantity_supplied("price", "base_price", "market", "supply_elasticity")
    out = out.withColumn("price", F.col("s.price")).withColumn("quantity", q)
    return base.rounded(out.select("geo1", "year", "alpha", "price", F.col("s.status").alias("status"), "quantity", (F.abs(F.col("native") - F.col("price")) < 1e-6).alias("agrees")), 4)


#: With constant elasticities the root has a closed form: base * (1 + alpha * U / Q) ^ (1 / (ed + es)).
EQUILIBRIUM = f"""WITH {SCENARIO}, e AS (SELECT *, p0 * (1 + alpha * u / q) ** (1 / (ed + es)) AS price FROM sa)
SELECT geo1, year, alpha, round(price, 4) AS price, 'converged' AS status, round(q * (price / p0) ** es, 4) AS quantity, true AS agrees FROM e"""


def dual_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices under entry and cost shifts; medians, share of rows that fall, and the frontier's quantiles."""
    axes = scenario.grid(spark, kq=(0.0, 0.25, 0.5, 1.0), kc=(0.0, 0.1, 0.25)).withColumn("alpha", F.lit(0.5))
    rows = lookups.with_grid(scenario_inputs(spark, sf_dir), axes)
    rows = rows.withColumn("price", scenario.solved(entry="kq", cost="kc")["price"]).withColumn("frontier", scenario.frontier("market", "unpaid", "supply_elasticity", "kc"))
    down = F.avg((F.col("price") < F.col("base_price")).cast("double")).alias("share_down")
    return base.rounded(rows.groupBy("kq", "kc").agg(*scenario.median_columns(["price", "frontier"], 0.1, 0.9), down, F.count("*").alias("n")), 4)


DUAL = f"""WITH {SCENARIO}, g AS (SELECT kq, kc FROM (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS kq), (SELECT unnest([0.0, 0.1, 0.25])::DOUBLE AS kc)),
r AS (SELECT *, p0 * ((1 + 0.5 * u / q) * exp(-kq * 0.5) * exp(kc * 0.5 * es)) ** (1 / (ed + es)) AS price, u / q + es * kc AS frontier FROM sc, g)
SELECT kq, kc, round(median(price), 4) AS median_price, round(median(frontier), 4) AS median_frontier, round(quantile_cont(price, 0.1), 4) AS low_price, round(quantile_cont(frontier, 0.1), 4) AS low_frontier,
  round(quantile_cont(price, 0.9), 4) AS high_price, round(quantile_cont(frontier, 0.9), 4) AS high_frontier, round(avg(CASE WHEN price < p0 THEN 1.0 ELSE 0.0 END), 4) AS share_down, count(*) AS n FROM r GROUP BY ALL"""


def piecewise_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise against constant supply."""
    rows = lookups.with_grid(scenario_inputs(spark, sf_dir), scenario.grid(spark, alpha=scenario.ALPHAS)).withColumn("above", F.col("supply_elasticity") / 2)
    rows = rows.withColumns({"constant": scenario.solved()["price"], "piecewise": scenario.solved(above="above")["price"]})
    return base.rounded(rows.groupBy("alpha").agg(*scenario.median_columns(["constant", "piecewise"]), F.avg(F.col("piecewise") - F.col("constant")).alias("mean_gap")), 4)


PIECE_SC = f"""WITH {SCENARIO}, r AS (SELECT alpha, p0 * (1 + alpha * u / q) ** (1 / (ed + es)) AS c, p0 * (1 + alpha * u / q) ** (1 / (ed + es / 2)) AS p FROM sa)
SELECT alpha, round(median(c), 4) AS median_constant, round(median(p), 4) AS median_piecewise, round(avg(p - c), 4) AS mean_gap FROM r GROUP BY alpha"""


def bootstrap(spark: SparkSession, sf_dir: str, draws: int = 40) -> DataFrame:
    """States drawn with replacement; each draw's fit is a reweighted sum of the states' moments; 10-90 % intervals."""
    rows = demand_rows(spark, sf_dir)
    times = scenario.draw_multiplicities(rows.select("geo1"), "geo1", draws, 42)
    per_state = rows.groupBy("geo1").agg(*[F.sum(e).alias(n) for n, e in (("w", F.col("rw")), ("x", F.col("rw") * F.col("outside")), ("y", F.col("rw") * F.col("price")), ("xx", F.col("rw") * F.col("outside") * F.col("outside")), ("xy", F.col("rw") * F.col("outside") * F.col("price")))])
    s = times.join(per_state, "geo1").groupBy("draw").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("w", "x", "y", "xx", "xy")])
    fits = s.withColumn("slope", F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("w"), F.col("xx") - F.col("x") * F.col("x") / F.col("w")))
    return base.rounded(fits.agg(F.count("*").alias("draws"), F.avg((F.col("slope") > 0).cast("double")).alias("accepted"), *scenario.median_columns(["slope"], 0.1, 0.9)))


BOOTSTRAP = f"""WITH {DEMAND}, g AS (SELECT geo1, row_number() OVER (ORDER BY geo1) - 1 AS i FROM (SELECT DISTINCT geo1 FROM dem)), n AS (SELECT count(*) AS n FROM g),
t AS (SELECT d AS draw, ((((42 * 7919 + d * 104729 + i * 1299709 + 12345) * 48271) % 2147483647 * 48271) % 2147483647) % n AS i FROM g, n, (SELECT unnest(range(0, 40)) AS d)),
m AS (SELECT geo1, sum(rw) AS w, sum(rw * outside) AS x, sum(rw * price) AS y, sum(rw * outside * outside) AS xx, sum(rw * outside * price) AS xy FROM dem GROUP BY geo1),
f AS (SELECT draw, sum(w) AS w, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM t JOIN g USING (i) JOIN m USING (geo1) GROUP BY draw), s AS (SELECT (xy - x * y / w) / (xx - x * x / w) AS slope FROM f)
SELECT count(*) AS draws, round(avg(CASE WHEN slope > 0 THEN 1.0 ELSE 0.0 END), 6) AS accepted, round(median(slope), 6) AS median_slope, round(quantile_cont(slope, 0.1), 6) AS low_slope, round(quantile_cont(slope, 0.9), 6) AS high_slope FROM s"""


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decomposition under nine staffing and fringe assumptions, medians of each case."""
    rows = panels.decomposition(spark, sf_dir).select("price", "wage", "children_per_worker")
    cases = scenario.grid(spark, staffing=(0.8, 1.0, 1.2), fringe=(1.0, 1.2, 1.4))
    rows = lookups.with_grid(rows, cases)
    raw = F.col("wage") * 400 * F.col("fringe") * F.col("staffing") / F.col("children_per_worker")
    rows = rows.withColumn("direct", F.greatest(F.least("price", raw), F.lit(0.0))).withColumn("direct", F.when(raw.isNotNull(), F.col("direct")))
    return base.rounded(rows.groupBy("staffing", "fringe").agg(*scenario.median_columns(["direct"]), F.avg((raw > F.col("price")).cast("double")).alias("clip_share")), 4)


SENSITIVITY = f"""WITH {panels.DECOMPOSED}, g AS (SELECT s, f FROM (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS s), (SELECT unnest([1.0, 1.2, 1.4])::DOUBLE AS f)),
r AS (SELECT s, f, price, wage * 400 * f * s / children_per_worker AS raw FROM dec, g)
SELECT s AS staffing, f AS fringe, round(median(CASE WHEN raw IS NOT NULL THEN greatest(least(price, raw), 0) END), 4) AS median_direct, round(avg(CAST(raw > price AS DOUBLE)), 4) AS clip_share FROM r GROUP BY ALL"""

REGISTERED = {
    "iv_results": (iv_results, IV_RESULTS), "iv_summary": (iv_summary, IV_SUMMARY), "price_surface": (surface, SURFACE),
    "supply_slopes": (slopes, SLOPES), "supply_elasticity": (elasticity, ELASTICITY), "piecewise_supply": (piecewise, PIECEWISE), "rule_shocks": (rule_shocks, RULE_SHOCKS),
    "exposure_design": (exposure, EXPOSURE), "clustered_iv": (clustered, CLUSTERED), "leave_one_state_out_iv": (left_out, LEFT_OUT),
    "weighted_fit": (weighted_fit, WEIGHTED_FIT), "threshold_sweep_iv": (instrumented, INSTRUMENTED),
    "switching_model": (switching, SWITCHING), "first_component": (components, None), "stringency_index": (stringency, STRINGENCY), "equilibrium_prices": (equilibrium, EQUILIBRIUM),
    "dual_shift": (dual_shift, DUAL), "piecewise_scenario": (piecewise_scenario, PIECE_SC), "cluster_bootstrap": (bootstrap, BOOTSTRAP), "decomposition_sensitivity": (sensitivity, SENSITIVITY),
}
