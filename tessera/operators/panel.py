"""Panel builders: prices, hours, wages, staffing, decomposition, densities, sample ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import weighted as W

from . import impute, lookups


def county_year(df: DataFrame, keys: list[str], price: str, weight: str, imputed: str) -> DataFrame:
    """Strict weighted price, imputed share and row count."""
    return df.groupBy(*keys).agg(
        W.weighted_mean_strict(price, weight).alias("price"), F.avg(F.col(imputed).cast("double")).alias("imputed_share"), F.count("*").alias("n")
    )


def state_hours(df: DataFrame, keys: list[str], hours: list[str], controls: list[str], weight: str, periods: float = 52.0) -> DataFrame:
    """Weighted mean hours times the periods of a year, totals, weighted mean controls, total weight."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(
        *[(W.weighted_mean_strict(h, weight) * periods).alias(h) for h in hours], *[W.weighted_total(h, weight, periods).alias(f"{h}_total") for h in hours],
        *[W.weighted_mean_strict(c, weight).alias(c) for c in controls], F.sum(w).alias("weight_sum"),
    )


def labour_panel(county: DataFrame, state_wage: DataFrame, geo1: str = "geo1", year: str = "year") -> DataFrame:
    """Wage: county, else state; outside option: state, else the wage times the year's, the nearest year's or the overall median ratio.

    ``county`` has wage and outside; ``state_wage`` has state_wage and state_outside by (geo1, year).
    """
    rows = county.join(state_wage, [geo1, year], "left")
    wage, wage_label = impute.first_of([("county_observed", F.col("wage")), ("state_occupation", F.col("state_wage"))])
    rows = rows.withColumns({"wage_source": wage_label, "wage": wage})
    both = state_wage.filter((F.col("state_wage") > 0) & (F.col("state_outside") > 0)).withColumn("_r", F.col("state_outside") / F.col("state_wage"))
    by_year = both.groupBy(year).agg(F.median("_r").alias("_same"))
    nearest = lookups.nearest_year_map(county, by_year, year).join(by_year.select(F.col(year).alias("source_year"), F.col("_same").alias("_near")), "source_year")
    overall = both.agg(F.median("_r").alias("_all"))
    rows = rows.join(F.broadcast(by_year), year, "left").join(F.broadcast(nearest.drop("source_year")), year, "left").crossJoin(F.broadcast(overall))
    outside, label = impute.first_of([
        ("state_observed", F.col("state_outside")), ("same_year_ratio", F.col("wage") * F.col("_same")),
        ("nearest_year_ratio", F.col("wage") * F.col("_near")), ("national_ratio", F.col("wage") * F.col("_all")),
    ])
    return rows.withColumns({"outside_source": label, "outside": outside}).drop("_same", "_near", "_all", "state_wage", "state_outside")


def staffing_mix(df: DataFrame, keys: list[str], ratio: Column, weight: str) -> DataFrame:
    """P5: workers per child as a ratio of sums over the mix, and its inverse."""
    out = df.withColumn("_ratio", ratio).groupBy(*keys).agg(W.ratio_of_sums("_ratio", weight).alias("workers_per_child"))
    return out.withColumn("children_per_worker", F.try_divide(F.lit(1.0), F.nullif("workers_per_child", F.lit(0.0))))


def decomposed(df: DataFrame, hours: float = 2080.0, fringe: float = 1.2, price: str = "price", wage: str = "wage", children: str = "children_per_worker") -> DataFrame:
    """Direct labour price = wage * hours * fringe / children, at most the price; residual, share, implied wage, whether the clip binds."""
    raw = F.col(wage) * hours * fringe / F.nullif(F.col(children), F.lit(0.0))
    direct = F.greatest(F.least(F.col(price), F.col("direct_raw")), F.lit(0.0))
    rows = df.withColumn("direct_raw", raw).withColumn("direct_price", F.when(F.col(price).isNotNull() & F.col("direct_raw").isNotNull(), direct))
    return rows.withColumns({
        "residual_price": F.col(price) - F.col("direct_price"), "direct_share": F.try_divide(F.col("direct_price"), F.col(price)),
        "implied_wage": F.col("direct_price") * F.col(children) / (hours * fringe), "clip_binds": F.coalesce(F.col("direct_raw") > F.col(price), F.lit(False)),
    })


def with_density(df: DataFrame, establishments: str = "establishments", nonemployers: str = "nonemployers", employment: str = "n", population: str = "population") -> DataFrame:
    """Firms per 1000: either kind if known, else employment."""
    e, s = F.col(establishments), F.col(nonemployers)
    firms = F.when(e.isNotNull() | s.isNotNull(), F.coalesce(e, F.lit(0.0)) + F.coalesce(s, F.lit(0.0))).otherwise(F.col(employment).cast("double"))
    return df.withColumn("density", F.try_divide(firms * 1000.0, F.nullif(F.col(population), F.lit(0.0))))


def with_benchmark_wages(df: DataFrame) -> DataFrame:
    """Benchmark wage (own, else outside), and the cost of the hours at it."""
    out = df.withColumn("benchmark_wage", F.coalesce("wage", "outside"))
    return out.withColumn("replacement_cost", F.col("benchmark_wage") * F.col("population"))


def with_share_fill(df: DataFrame, slots: DataFrame, geo: str) -> DataFrame:
    """A year-less cross-section joined by place; missing slots are the population times a median ratio of the group; ``capacity_share`` of the population, 1 at most."""
    rows = df.join(slots, geo, "left")
    out = impute.fill_from_group_medians(rows, "slots", "population", "slots_source", [("state_year", ["geo1", "year"]), ("state", ["geo1"]), ("year", ["year"]), ("national", [])])
    share = F.try_divide(F.col("slots"), F.nullif(F.col("population"), F.lit(0.0)))
    return out.withColumn("capacity_share", F.when(share > 1, 1.0).otherwise(share))


#: The measures of the support metadata, all weighted by population (A2).
SUPPORT = [
    "price", "density", "benchmark_wage", "specialist_wage", "outside", "imputed_share", "direct_price", "direct_raw", "residual_price", "direct_share", "clip",
    "workers_per_child", "implied_wage", "wage_observed", "employment_observed", "labour_observed",
]


def support_metadata(df: DataFrame, keys: list[str], wage_source: str, employment_source: str, weight: str = "population") -> DataFrame:
    """The sixteen measures of a place and year: prices and their parts, wages, and the shares of rows whose labour sources are observed; the inverse staffing ratio; whether the clip binds anywhere.

    ``df`` is the decomposed county panel with densities and wages; a source is observed if its label ends so.
    """
    seen = {n: F.coalesce(F.col(c).endswith("observed"), F.lit(False)).cast("double") for n, c in (("wage_observed", wage_source), ("employment_observed", employment_source))}
    rows = df.withColumns({**seen, "clip": F.col("clip_binds").cast("double"), "specialist_wage": F.coalesce("outside", "benchmark_wage")})
    rows = rows.withColumn("labour_observed", F.least("wage_observed", "employment_observed"))
    out = W.to_groups(rows, keys, SUPPORT, weight, weight)
    return out.withColumns({"children_per_worker": F.try_divide(F.lit(1.0), F.nullif("workers_per_child", F.lit(0.0))), "clip_binds": F.col("clip") > 0})


def coverage_counts(df: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates for a one-row summary: rows, rows with each value, positive rows."""
    out = [F.count("*").alias("n_rows")]
    for c in columns:
        out += [F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"n_{c}_positive")]
    return out
