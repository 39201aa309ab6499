"""Weighted aggregates, panels, imputation and sample ladders (A, J, P, W families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import weighted as W
from tessera.operators import account, impute, ladders, lookups, panel, quantiles

from . import base

RATIOS = {"STANDARD": 0.25, "SMALL": 0.2, "MEDIUM": 0.125, "LARGE": 0.1, "ECONOMY": 0.0833, "PROMO": 0.0667}
_RATIO_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATIOS.items()) + " END"


def staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_type")
    ratio = F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv])[F.col("p_type")]
    return panel.staffing_mix(base.micro(spark, sf_dir).join(parts, "partkey"), ["geo1", "geo2", "year"], ratio, "weight")


STAFFING = f"""staffing AS (SELECT geo1, geo2, year, sum(({_RATIO_SQL}) * weight) / greatest(sum(weight), 1e-9) AS workers_per_child
  FROM micro JOIN part ON partkey = p_partkey GROUP BY geo1, geo2, year)"""


def decomposition(spark: SparkSession, sf_dir: str, county: DataFrame | None = None) -> DataFrame:
    rows = (base.county(spark, sf_dir) if county is None else county).join(staffing(spark, sf_dir), ["geo1", "geo2", "year"])
    return panel.decomposed(rows.withColumn("price", F.col("price")), hours=400.0)


_CHILDREN = "1.0 / nullif(workers_per_child, 0)"
DECOMPOSED = f"""{base.COUNTY}, {STAFFING},
dec0 AS (SELECT county.*, workers_per_child, {_CHILDREN} AS children_per_worker, wage * 400.0 * 1.2 / nullif({_CHILDREN}, 0) AS direct_raw
  FROM county JOIN staffing USING (geo1, geo2, year)),
dec AS (SELECT *, CASE WHEN price IS NOT NULL AND direct_raw IS NOT NULL THEN greatest(least(price, direct_raw), 0.0) END AS direct_price FROM dec0)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County prices, decomposed, rolled up to state and year."""
    rows = decomposition(spark, sf_dir)
    means = [W.weighted_mean_or_mean(c, "population").alias(c) for c in ("price", "direct_price", "residual_price", "direct_share", "implied_wage")]
    out = rows.groupBy("geo1", "year").agg(*means, F.sum("population").alias("population"), W.share_positive(F.col("clip_binds")).alias("clip_share"))
    return base.rounded(out).orderBy("geo1", "year")


_FLAG = ["price", "direct_price", "residual_price", "direct_share", "implied_wage"]
FLAGSHIP = f"""WITH {DECOMPOSED}, d AS (SELECT *, price - direct_price AS residual_price, direct_price / nullif(price, 0) AS direct_share,
  direct_price * children_per_worker / (400.0 * 1.2) AS implied_wage, coalesce(direct_raw > price, false) AS clip_binds FROM dec)
SELECT geo1, year, {", ".join(f"round({base.a2(c, 'population')}, 6) AS {c}" for c in _FLAG)}, round(sum(population), 6) AS population,
  round(avg(CASE WHEN clip_binds THEN 1.0 ELSE 0.0 END), 6) AS clip_share FROM d GROUP BY geo1, year"""


def county_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, densities, benchmark wages, replacement cost by county and year."""
    rows = panel.with_benchmark_wages(panel.with_density(base.county(spark, sf_dir)))
    return base.rounded(rows.select("geo1", "geo2", "year", "price", "imputed_share", "n", "density", "benchmark_wage", "replacement_cost"))


_DENSITY = "(CASE WHEN establishments IS NOT NULL OR nonemployers IS NOT NULL THEN coalesce(establishments, 0) + coalesce(nonemployers, 0) ELSE n END) * 1000.0 / nullif(population, 0)"
COUNTY_PANEL = f"""WITH {base.COUNTY} SELECT geo1, geo2, year, round(price, 6) AS price, round(imputed_share, 6) AS imputed_share, n, round({_DENSITY}, 6) AS density,
  round(coalesce(wage, outside), 6) AS benchmark_wage, round(coalesce(wage, outside) * population, 6) AS replacement_cost FROM county"""


def weighted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weighted mean on the same data with missing values and zero weights."""
    m = base.micro(spark, sf_dir).withColumns({"v": F.when(F.col("line") == 3, F.lit(None)).otherwise(F.col("price")), "w": F.when(F.col("flag") == "R", 0.0).otherwise(F.col("weight"))})
    return base.rounded(m.groupBy("geo1", "year").agg(
        W.weighted_mean_strict("price", "weight").alias("a1"), W.weighted_mean_or_mean("v", "w").alias("a2"), W.weighted_mean_or_null("v", "w").alias("a3"),
        W.weighted_mean_nulls_zero("v", "w").alias("a4"), W.quantity_price("price", "w").alias("a5"), W.ratio_of_sums("v", "weight").alias("a6"),
        W.weighted_total("price", "weight", 52.0).alias("a7"), W.rate_of_sums(F.col("w"), F.col("weight"), F.col("discount")).alias("a8"),
        W.share_positive(F.col("imputed")).alias("share_imputed"), F.bool_or("imputed").alias("any_imputed"), F.bool_and("observed").alias("all_observed"),
        W.first_known("v", F.struct("orderkey", "line", "partkey", "suppkey", "price")).alias("first_v"), W.first_text(F.when(F.col("line") > 1, F.col("provider")), F.struct("orderkey", "line", "partkey", "suppkey", "price")).alias("first_text"),
        W.joined_texts("flag").alias("flags"), F.count_distinct("geo2").alias("n_counties"),
    ))


VARIANTS = f"""WITH {base.MICRO}, m AS (SELECT *, CASE WHEN line = 3 THEN NULL ELSE price END AS v, CASE WHEN flag = 'R' THEN 0.0 ELSE weight END AS w FROM micro)
SELECT geo1, year, round(sum(price * weight) / sum(weight), 6) AS a1, round({base.a2("v", "w")}, 6) AS a2,
  round(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN v * w END) / sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END), 6) AS a3,
  round(coalesce(CASE WHEN sum(w) > 0 THEN sum(coalesce(v, 0) * w) / sum(w) END, avg(coalesce(v, 0)), 0), 6) AS a4,
  round(coalesce(sum(price * w) / nullif(sum(w), 0), 0), 6) AS a5, round(coalesce(sum(v * weight), 0) / greatest(sum(weight), 1e-9), 6) AS a6,
  round(sum(price * weight * 52), 6) AS a7, round(coalesce(sum(w) / nullif(sum(weight), 0), avg(discount)), 6) AS a8,
  round(avg(CASE WHEN imputed THEN 1.0 ELSE 0.0 END), 6) AS share_imputed, bool_or(imputed) AS any_imputed, bool_and(observed) AS all_observed,
  round(arg_min(v, (orderkey, line, partkey, suppkey, price)) FILTER (v IS NOT NULL), 6) AS first_v,
  coalesce(arg_min(provider, (orderkey, line, partkey, suppkey, price)) FILTER (line > 1), 'missing') AS first_text, array_to_string(list_sort(list_distinct(list(flag))), '|') AS flags, count(DISTINCT geo2) AS n_counties
FROM m GROUP BY geo1, year"""


def labour_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wages and outside options with their fallback labels."""
    c = base.county(spark, sf_dir).select("geo1", "geo2", "year", "wage", F.lit(None).cast("double").alias("outside"))
    # all rows are read; one year's and some states' values are hidden, so that the ladder has gaps to fill
    shown = (F.col("year") != 1997) & (F.col("geo1") % 6 != 1)
    state = base.county(spark, sf_dir).groupBy("geo1", "year").agg((F.avg("population") * 2).alias("state_wage"), F.avg("outside").alias("state_outside"))
    state = state.withColumns({"state_wage": F.when(shown, F.col("state_wage")), "state_outside": F.when(shown & ((F.col("geo1") + F.col("year")) % 3 != 0), F.col("state_outside"))})
    return base.rounded(panel.labour_panel(c, state))


LABOUR = f"""WITH {base.COUNTY}, st AS (SELECT geo1, year, CASE WHEN year <> 1997 AND geo1 % 6 <> 1 THEN avg(population) * 2 END AS state_wage, CASE WHEN year <> 1997 AND geo1 % 6 <> 1 AND (geo1 + year) % 3 <> 0 THEN avg(outside) END AS state_outside FROM county GROUP BY geo1, year),
r AS (SELECT year, median(state_outside / state_wage) AS m FROM st WHERE state_wage > 0 AND state_outside > 0 GROUP BY year),
a AS (SELECT median(state_outside / state_wage) AS m FROM st WHERE state_wage > 0 AND state_outside > 0),
y AS (SELECT DISTINCT year FROM county),
nr AS (SELECT y.year, arg_min(r.m, (abs(r.year - y.year), r.year)) AS m FROM y, r GROUP BY y.year),
j AS (SELECT geo1, geo2, c.year, coalesce(c.wage, state_wage) AS wage, CASE WHEN c.wage IS NOT NULL THEN 'county_observed' WHEN state_wage IS NOT NULL THEN 'state_occupation' ELSE 'missing' END AS wage_source,
  state_outside, r.m AS same, nr.m AS near, a.m AS allm FROM county c LEFT JOIN st USING (geo1, year) LEFT JOIN r ON r.year = c.year LEFT JOIN nr ON nr.year = c.year CROSS JOIN a)
SELECT geo1, geo2, year, round(wage, 6) AS wage, wage_source, round(coalesce(state_outside, wage * same, wage * near, wage * allm), 6) AS outside,
  CASE WHEN state_outside IS NOT NULL THEN 'state_observed' WHEN wage * same IS NOT NULL THEN 'same_year_ratio' WHEN wage * near IS NOT NULL THEN 'nearest_year_ratio' WHEN wage * allm IS NOT NULL THEN 'national_ratio' ELSE 'missing' END AS outside_source FROM j"""


def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside options filled from median ratios of state-year, state, year, then all."""
    rows = base.county(spark, sf_dir).withColumn("base_value", F.col("population")).withColumn("outside", F.when((F.col("geo1") % 5 != 2) & ((F.col("geo1") % 4 != 1) | (F.col("year") != 1999)), F.col("outside")))
    levels = [("state_year", ["geo1", "year"]), ("state", ["geo1"]), ("year", ["year"]), ("national", [])]
    out = impute.fill_from_group_medians(rows, "outside", "base_value", "outside_source", levels)
    return base.rounded(out.select("geo1", "geo2", "year", "outside", "outside_source"))


MEDIANS = f"""WITH {base.COUNTY}, c AS (SELECT geo1, geo2, year, population AS b, CASE WHEN geo1 % 5 <> 2 AND (geo1 % 4 <> 1 OR year <> 1999) THEN outside END AS v FROM county),
r AS (SELECT *, CASE WHEN v > 0 AND b > 0 THEN v / b END AS q FROM c),
m0 AS (SELECT geo1, year, median(q) AS m0 FROM r GROUP BY ALL), m1 AS (SELECT geo1, median(q) AS m1 FROM r GROUP BY ALL), m2 AS (SELECT year, median(q) AS m2 FROM r GROUP BY ALL), m3 AS (SELECT median(q) AS m3 FROM r)
SELECT geo1, geo2, year, round(coalesce(v, b * coalesce(m0, m1, m2, m3)), 6) AS outside,
  CASE WHEN v IS NOT NULL THEN 'observed' WHEN m0 IS NOT NULL THEN 'state_year' WHEN m1 IS NOT NULL THEN 'state' WHEN m2 IS NOT NULL THEN 'year' WHEN m3 IS NOT NULL THEN 'national' ELSE 'missing' END AS outside_source
FROM r LEFT JOIN m0 USING (geo1, year) LEFT JOIN m1 USING (geo1) LEFT JOIN m2 USING (year) CROSS JOIN m3"""


def sample_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion reasons, core eligibility, and the support window of each state-year."""
    s = ladders.support_window(base.state(spark, sf_dir), base.micro(spark, sf_dir).filter(f"year <= {base.CORE_LAST}"))
    outside_window = ~F.col("year").between(base.CORE_FIRST, base.CORE_LAST)
    broad = [("outside_window", outside_window), ("sensitivity_year", F.col("year") == base.SENSITIVITY), ("no_price", F.col("price").isNull()), ("no_controls", F.col("outside").isNull())]
    reason = ladders.first_reason([*broad, ("high_imputation", F.col("imputed_share") > 0.34)])
    core = ladders.first_reason([*broad, ("not_in_support", F.col("support_window") != "in_support"), ("low_observed_share", F.col("observed_share") < 0.45)])
    out = s.withColumns({"reason": reason, "core_reason": core})
    out = out.withColumns({"eligible": F.col("reason") == "eligible", "core_eligible": F.col("core_reason") == "eligible", "price_of_max": F.col("price") / F.max("price").over(Window.partitionBy("year"))})
    return base.rounded(out.select("geo1", "year", "support_window", "reason", "core_reason", "eligible", "core_eligible", "price_of_max"))


LADDER = f"""WITH {base.STATE}, e AS (SELECT min(year) AS a, max(year) AS b FROM micro WHERE year <= {base.CORE_LAST}),
l AS (SELECT state.*, CASE WHEN year < a THEN 'pre_support' WHEN year > b THEN 'nowcast' ELSE 'in_support' END AS support_window FROM state, e),
r AS (SELECT *, CASE WHEN NOT year BETWEEN {base.CORE_FIRST} AND {base.CORE_LAST} THEN 'outside_window' WHEN year = {base.SENSITIVITY} THEN 'sensitivity_year' WHEN price IS NULL THEN 'no_price' WHEN outside IS NULL THEN 'no_controls' END AS first FROM l)
SELECT geo1, year, support_window, coalesce(first, CASE WHEN imputed_share > 0.34 THEN 'high_imputation' ELSE 'eligible' END) AS reason,
  coalesce(first, CASE WHEN support_window <> 'in_support' THEN 'not_in_support' WHEN observed_share < 0.45 THEN 'low_observed_share' ELSE 'eligible' END) AS core_reason,
  reason = 'eligible' AS eligible, core_reason = 'eligible' AS core_eligible, round(price / max(price) OVER (PARTITION BY year), 6) AS price_of_max FROM r"""


def year_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of, nearest and carried lookups over years with gaps."""
    s = base.state(spark, sf_dir)
    held = s.filter("year in (1996, 1999)")
    rates = held.groupBy("year").agg(F.avg("price").alias("rate"))
    a = lookups.asof_year_map(s, held).withColumnRenamed("source_year", "asof_year")
    n = lookups.nearest_year_map(s, held).withColumnRenamed("source_year", "nearest_year")
    return base.rounded(a.join(n, "year").join(lookups.carried_rates(s, rates, "rate"), "year"))


YEAR_MAPS = f"""WITH {base.STATE}, h AS (SELECT year AS a, avg(price) AS v FROM state WHERE year IN (1996, 1999) GROUP BY year), y AS (SELECT DISTINCT year FROM state)
SELECT year, coalesce(max(a) FILTER (a <= year), max(a)) AS asof_year, arg_min(a, (abs(a - year), a)) AS nearest_year,
  coalesce(max(a) FILTER (a <= year), min(a) FILTER (a > year)) AS source_year,
  round(coalesce(arg_max(v, a) FILTER (a <= year), arg_min(v, a) FILTER (a > year)), 6) AS rate,
  CASE WHEN bool_or(a = year) THEN 'exact' WHEN bool_or(a < year) THEN 'carry_forward' ELSE 'carry_backward' END AS rate_label FROM y, h GROUP BY year"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County measures through the nation-to-region bridge, with the year's maximum."""
    b = base.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geo1"), F.col("n_regionkey").alias("metro"))
    c = base.county(spark, sf_dir)
    out = lookups.through_bridge(c, b, "geo1", ["metro", "year"], [W.rate_of_sums("establishments", "population", "imputed_share").alias("rate"), F.sum("n").alias("load"), F.count_distinct("geo2").alias("n_counties")])
    return base.rounded(out.withColumn("exposure", F.col("load") / F.max("load").over(Window.partitionBy("year"))))


BRIDGE = f"""WITH {base.COUNTY}, a AS (SELECT n_regionkey AS metro, year, coalesce(sum(establishments) / nullif(sum(population), 0), avg(imputed_share)) AS rate, CAST(sum(n) AS BIGINT) AS load, count(DISTINCT geo2) AS n_counties
  FROM county JOIN nation ON geo1 = n_nationkey GROUP BY ALL)
SELECT metro, year, round(rate, 6) AS rate, load, n_counties, round(load / max(load) OVER (PARTITION BY year), 6) AS exposure FROM a"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts about the panel, and how many of its place-years another table has."""
    c = base.county(spark, sf_dir)
    counts = c.agg(*panel.coverage_counts(c, ["price", "wage", "outside", "establishments"]))
    held = c.join(base.table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("geo1")), "geo1", "left_semi")
    return counts.crossJoin(lookups.coverage(c, held, ["geo1", "year"]))


COVERAGE = f"""WITH {base.COUNTY}, k AS (SELECT DISTINCT geo1, year FROM county)
SELECT (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM k WHERE geo1 IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) AS n_covered, count(*) AS n_rows,
  {", ".join(f"count({c}) AS n_{c}, count(*) FILTER ({c} > 0) AS n_{c}_positive" for c in ("price", "wage", "outside", "establishments"))} FROM county"""


def home_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outsourced cost of the job group on every job, own cost as fallback; sequence in the household."""
    m = base.micro(spark, sf_dir).join(base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("job_group")), "partkey")
    means = m.filter("flag <> 'R' and job_group <> 'PROMO'").groupBy("job_group").agg(F.avg("amount").alias("group_cost"))
    number = F.row_number().over(Window.partitionBy("geo2").orderBy("orderkey", "line", "partkey", "suppkey", "amount"))
    out = m.join(F.broadcast(means), "job_group", "left").withColumns({"job_id": number, "diy": F.col("flag") == "R"})
    return base.rounded(out.groupBy("geo1", "job_group").agg(F.count("*").alias("jobs"), F.avg(F.col("diy").cast("double")).alias("diy_share"), F.avg(F.coalesce("group_cost", "amount")).alias("mean_cost"), F.max("job_id").alias("most_jobs")))


HOME = f"""WITH {base.MICRO}, m AS (SELECT micro.*, p_type AS job_group FROM micro JOIN part ON partkey = p_partkey),
g AS (SELECT job_group, avg(amount) AS group_cost FROM m WHERE flag <> 'R' AND job_group <> 'PROMO' GROUP BY ALL),
j AS (SELECT *, row_number() OVER (PARTITION BY geo2 ORDER BY orderkey, line, partkey, suppkey, amount) AS job_id FROM m LEFT JOIN g USING (job_group))
SELECT geo1, job_group, count(*) AS jobs, round(avg(CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS diy_share, round(avg(coalesce(group_cost, amount)), 6) AS mean_cost, max(job_id) AS most_jobs FROM j GROUP BY ALL"""


def state_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted yearly hours, totals and controls by state and year."""
    m = base.micro(spark, sf_dir)
    return base.rounded(panel.state_hours(m, ["geo1", "year"], ["price"], ["discount", "amount"], "weight"))


HOURS = f"""WITH {base.MICRO} SELECT geo1, year, round(sum(price * weight) / sum(weight) * 52, 6) AS price, round(sum(price * weight * 52), 6) AS price_total,
  round(sum(discount * weight) / sum(weight), 6) AS discount, round(sum(amount * weight) / sum(weight), 6) AS amount, round(sum(weight), 6) AS weight_sum FROM micro GROUP BY ALL"""


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and weighted medians, quantiles, by distributed selection."""
    m = base.micro(spark, sf_dir)
    return base.rounded(quantiles.summary(m, ["geo1"], "price", "weight", {"median": 0.5, "p10": 0.1, "p90": 0.9}))


MEDIAN_SQL = f"""WITH {base.MICRO}, v AS (SELECT geo1, price, sum(weight) AS w FROM micro GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY geo1 ORDER BY price ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY geo1) AS s FROM v),
h AS (SELECT geo1, min(price) AS weighted_median FROM r WHERE s >= 0.5 GROUP BY ALL)
SELECT geo1, round(median(price), 6) AS median, round(quantile_cont(price, 0.1), 6) AS p10, round(quantile_cont(price, 0.9), 6) AS p90, round(any_value(weighted_median), 6) AS weighted_median FROM micro JOIN h USING (geo1) GROUP BY geo1"""


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of source labels, and a pivot of statuses."""
    m = base.micro(spark, sf_dir)
    shares = W.value_shares(m, ["geo1"], "provider")
    wide = m.groupBy("geo1", "provider").pivot("flag", ["A", "N", "R"]).count().fillna(0).withColumnsRenamed({f: f"flag_{f}" for f in "ANR"})
    return base.rounded(shares.join(wide, ["geo1", "provider"]))


COUNTS = f"""WITH {base.MICRO}, c AS (SELECT geo1, provider, count(*) AS n, count(*) FILTER (flag = 'A') AS flag_A, count(*) FILTER (flag = 'N') AS flag_N, count(*) FILTER (flag = 'R') AS flag_R FROM micro GROUP BY geo1, provider)
SELECT geo1, provider, n, round(n / sum(n) OVER (PARTITION BY geo1), 6) AS share, flag_A, flag_N, flag_R FROM c"""


def top_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority order with a custom category order, the first ten; each with its latest year."""
    s = base.state(spark, sf_dir)
    latest = s.groupBy("geo1").agg(F.max_by("price", "year").alias("latest_price"), F.max("year").alias("latest_year"))
    tier = F.when(F.col("latest_price") > 2100, "high").when(F.col("latest_price") > 2050, "middle").otherwise("low")
    rank = F.array_position(F.array(F.lit("high"), F.lit("middle"), F.lit("low")), F.col("tier"))
    out = base.rounded(latest.withColumn("tier", tier)).orderBy(rank, F.desc("latest_price"), "geo1").limit(10)
    return out


TOP = f"""WITH {base.STATE}, l AS (SELECT geo1, arg_max(price, year) AS latest_price, max(year) AS latest_year FROM state GROUP BY geo1),
t AS (SELECT *, CASE WHEN latest_price > 2100 THEN 'high' WHEN latest_price > 2050 THEN 'middle' ELSE 'low' END AS tier FROM l)
SELECT geo1, round(latest_price, 6) AS latest_price, latest_year, tier FROM t ORDER BY list_position(['high', 'middle', 'low'], tier), round(latest_price, 6) DESC, geo1 LIMIT 10"""


def satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National yearly account from the decomposed panel and hours."""
    county = decomposition(spark, sf_dir)
    hours = base.micro(spark, sf_dir).groupBy("year").agg(F.avg("weight").alias("mean_hours"), F.sum("weight").alias("total_hours"), F.avg("discount").alias("mean_wage"))
    return base.rounded(account.satellite(county, hours))


SATELLITE = f"""WITH {DECOMPOSED}, p AS (SELECT year, {base.a2("price", "population")} AS annual_price, {base.a2("direct_price", "population")} AS direct_price, sum(population) AS population FROM dec GROUP BY year),
h AS (SELECT year, avg(weight) AS mean_hours, sum(weight) AS total_hours, avg(discount) AS mean_wage FROM micro GROUP BY year),
b AS (SELECT *, annual_price / (52 * mean_hours) AS hourly_price, total_hours / (52 * mean_hours) AS bridge_quantity FROM p JOIN h USING (year))
SELECT year, {", ".join(f"round({x}, 6) AS {n}" for x, n in (("annual_price", "annual_price"), ("direct_price", "direct_price"), ("population", "population"), ("mean_hours", "mean_hours"), ("total_hours", "total_hours"), ("mean_wage", "mean_wage"), ("hourly_price", "hourly_price"), ("bridge_quantity", "bridge_quantity"), ("hourly_price * total_hours", "value_hours_method"), ("annual_price * bridge_quantity", "value_quantity_method"), ("direct_price * bridge_quantity", "value_direct_care"), ("mean_wage * total_hours", "value_replacement"), ("bridge_quantity / nullif(population, 0)", "coverage_share")))} FROM b"""


def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median over the core window without the sensitivity year."""
    years = base.state(spark, sf_dir).groupBy("year").agg(F.avg("price").alias("price"), F.avg("imputed_share").alias("imputed_share"))
    return base.rounded(account.window_summary(years, ["price", "imputed_share"], base.CORE_FIRST, base.CORE_LAST, base.SENSITIVITY))


_IN = f"year BETWEEN {base.CORE_FIRST} AND {base.CORE_LAST} AND year <> {base.SENSITIVITY}"
WINDOW = f"""WITH {base.STATE}, y AS (SELECT year, avg(price) AS price, avg(imputed_share) AS imputed_share FROM state GROUP BY year)
SELECT count(*) FILTER ({_IN}) AS n_window_years, min(year) FILTER ({_IN}) AS first_year, max(year) FILTER ({_IN}) AS last_year,
  {", ".join(f"round(coalesce(avg({m}) FILTER ({_IN}), avg({m})), 6) AS mean_{m}, round(coalesce(median({m}) FILTER ({_IN}), median({m})), 6) AS median_{m}" for m in ("price", "imputed_share"))} FROM y"""

REGISTERED = {
    "flagship_state_prices": (flagship, FLAGSHIP), "county_panel": (county_panel, COUNTY_PANEL), "weighted_means": (weighted_variants, VARIANTS),
    "labour_ladder": (labour_ladder, LABOUR), "median_imputation": (median_imputation, MEDIANS), "sample_ladder": (sample_ladder, LADDER),
    "year_maps": (year_maps, YEAR_MAPS), "bridge_rollup": (bridge, BRIDGE), "key_coverage": (coverage, COVERAGE), "home_jobs": (home_jobs, HOME),
    "state_hours": (state_hours, HOURS), "price_medians": (medians, MEDIAN_SQL), "label_counts": (value_counts, COUNTS),
    "priority_states": (top_states, TOP), "satellite_account": (satellite, SATELLITE), "window_summary": (window_summary, WINDOW),
}
