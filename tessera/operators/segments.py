"""Segments, channels, utilisation and channel scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import weighted as W

from . import lookups, scenario

CHANNELS = ("private_unsubsidised", "private_subsidised", "public")


def definitions(spark: SparkSession, dimensions: dict[str, list[str]], channel: dict[str, str] | None = None) -> DataFrame:
    """G1: the product of dimension values (``*``: any) as a config-sized table with an id and a channel."""
    out = None
    for name, values in dimensions.items():
        one = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{name} string")
        out = one if out is None else out.crossJoin(one)
    names = list(dimensions)
    kind = F.lit("private")
    for value, c in (channel or {}).items():
        kind = F.when(F.array_contains(F.array(*names), value), c).otherwise(kind)
    return out.withColumn("segment_id", F.concat_ws("/", *names)).withColumn("segment_channel", kind)


def segment_prices(facts: DataFrame, segments: DataFrame, dimensions: list[str], keys: list[str]) -> DataFrame:
    """J9, then price (A2), weight, rows, imputed share, any, all."""
    joined = lookups.wildcard_join(facts, segments, dimensions)
    imputed = F.col("imputed").cast("double")
    return joined.groupBy(*keys, "segment_id", "segment_channel").agg(
        W.weighted_mean_or_mean("price", "weight").alias("segment_price"), F.sum(F.greatest("weight", F.lit(0.0))).alias("segment_weight"), F.count("*").alias("segment_rows"),
        F.avg(imputed).alias("imputed_share"), F.bool_or("imputed").alias("imputed_any"), F.bool_and("imputed").alias("imputed_all"),
    )


def pooled(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments to one price."""
    return segments.groupBy(*keys).agg(W.weighted_mean_or_mean("segment_price", "segment_weight").alias("pooled_price"), F.sum("segment_weight").alias("pooled_weight"), F.count("*").alias("n_segments"))


def price_gap(segments: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled segments against the direct benchmark."""
    direct = facts.groupBy(*keys).agg(W.weighted_mean_or_mean("price", "weight").alias("benchmark_price"))
    return pooled(segments, keys).join(direct, keys, "left").withColumn("gap", F.col("pooled_price") - F.col("benchmark_price"))


def shares_of_total(df: DataFrame, keys: list[str], weight: str, fallback: str) -> DataFrame:
    """Weight over the group's weight; else the fallback's share; else equal parts."""
    w = Window.partitionBy(*keys)
    total, other, n = F.sum(weight).over(w), F.sum(fallback).over(w), F.count("*").over(w)
    share = F.when(total > 0, F.col(weight) / total).when(other > 0, F.col(fallback) / other).otherwise(1.0 / n)
    label = F.when(total > 0, "weight").when(other > 0, "rows").otherwise("equal")
    return df.withColumns({"segment_share": share, "share_basis": label})


def public_slots(slots: DataFrame, admin: DataFrame, population: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """Program slots plus admin slots, labelled by which are known; a large gap to the population is downgraded."""
    rows = population.join(slots, keys, "left").join(admin, keys, "left")
    both = F.col("program_slots").isNotNull() & F.col("admin_slots").isNotNull()
    status = F.when(both, "explicit_both").when(F.col("program_slots").isNotNull(), "explicit_program").when(F.col("admin_slots").isNotNull(), "explicit_admin").otherwise("missing")
    total = F.coalesce("program_slots", F.lit(0.0)) + F.coalesce("admin_slots", F.lit(0.0))
    rows = rows.withColumns({"public_slots": total, "slot_share": F.try_divide(total, F.nullif(F.col("population"), F.lit(0.0))), "slot_status": status})
    return rows.withColumn("slot_status", F.when(F.col("slot_share") > gap, F.concat("slot_status", F.lit("_downgraded"))).otherwise(F.col("slot_status")))


def quantities(targets: DataFrame, public: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """private = max(target - public - subsidised, 0), dealt by segment shares; one row per component."""
    rows = targets.join(public, keys, "full_outer").fillna(0.0, ["target", "public_slots", "subsidised_slots"])
    rows = rows.withColumn("private", F.greatest(F.col("target") - F.col("public_slots") - F.col("subsidised_slots"), F.lit(0.0)))
    own = rows.join(shares.select(*keys, "segment_id", "segment_share"), keys, "left")
    private = own.select(*keys, F.lit("private_unsubsidised").alias("component"), F.coalesce("segment_id", F.lit("all")).alias("segment_id"), (F.col("private") * F.coalesce("segment_share", F.lit(1.0))).alias("quantity"), F.col("segment_id").isNull().alias("fallback"))
    others = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit("public").alias("component"), F.lit("public").alias("segment_id"), F.col("public_slots").alias("quantity"), F.lit(False).alias("fallback")),
        F.struct(F.lit("private_subsidised").alias("component"), F.lit("subsidised").alias("segment_id"), F.col("subsidised_slots").alias("quantity"), F.lit(False).alias("fallback")),
    )).alias("x")).select(*keys, "x.*")
    return private.unionByName(others.filter("component = 'public' or quantity > 0"))


def reconciled(parts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Component sums against the targets, any fallback, any negative."""
    sums = parts.groupBy(*keys).agg(F.sum("quantity").alias("component_sum"), F.bool_or("fallback").alias("any_fallback"), F.min("quantity").alias("least"))
    out = sums.join(targets, keys, "left")
    return out.select(*keys, "component_sum", "any_fallback", (F.col("least") < 0).alias("any_negative"), (F.col("component_sum") - F.coalesce("target", F.lit(0.0))).alias("difference"))


def channel_wide(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Channel sums as columns, absent channels 0."""
    return parts.groupBy(*keys).pivot("component", list(CHANNELS)).agg(F.sum("quantity")).fillna(0.0, list(CHANNELS))


def channel_inputs(wide: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """A row per channel; the unpaid quantity goes to the private channels by their share, none to the public one."""
    rows = wide.join(state, keys)
    private = F.col(CHANNELS[0]) + F.col(CHANNELS[1])

    def part(c: str) -> Column:
        share = F.lit(0.0) if c == "public" else F.coalesce(F.try_divide(F.col(c), F.nullif(private, F.lit(0.0))), F.lit(0.0))
        return F.struct(F.lit(c).alias("channel"), F.col(c).alias("market"), (F.col("unpaid") * share).alias("channel_unpaid"))

    return rows.withColumn("x", F.explode(F.array(*[part(c) for c in CHANNELS]))).select(*keys, "base_price", "supply_elasticity", "demand_elasticity", "x.*")


def channel_scenarios(inputs: DataFrame, alphas: DataFrame) -> DataFrame:
    """Private channels respond through the solver, the public one keeps its baseline."""
    rows = lookups.with_grid(inputs, alphas).withColumn("unpaid", F.col("channel_unpaid"))
    responds = (F.col("channel") != "public") & (F.col("market") > 0) & (F.col("base_price") > 0)
    solved = rows.filter(responds).withColumn("s", scenario.solved())
    kept = rows.filter(~responds | responds.isNull())
    quantity = scenario.quantity_supplied("price", "base_price", "market", "supply_elasticity")
    a = solved.withColumns({"price": F.col("s.price"), "solver_status": F.col("s.status")}).drop("s").withColumn("quantity", quantity)
    b = kept.withColumns({"price": F.col("base_price"), "solver_status": F.lit("baseline"), "quantity": F.col("market")})
    return a.unionByName(b).drop("unpaid")


def scenario_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and quantity-weighted prices (A5) of the private and the public side, and public-price invariance."""
    private = F.col("channel") != "public"
    return rows.groupBy(*keys, "alpha").agg(
        F.sum(F.when(private, F.col("quantity")).otherwise(0.0)).alias("private_quantity"), F.sum(F.when(~private, F.col("quantity")).otherwise(0.0)).alias("public_quantity"),
        W.quantity_price(F.when(private, F.col("price")).otherwise(0.0), F.when(private, F.col("quantity")).otherwise(0.0)).alias("private_price"),
        F.coalesce(F.bool_and(F.when(~private, F.col("price") == F.col("base_price"))), F.lit(True)).alias("public_price_fixed"),
    )


def nearest_alpha(df: DataFrame, keys: list[str], alpha: str = "alpha", target: float = 0.5) -> DataFrame:
    """The row closest to the headline alpha, ties to the lower."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col(alpha) - target), alpha))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
