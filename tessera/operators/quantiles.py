"""Exact quantiles and weighted medians by distributed selection; no task holds a group.

Equal values of a group are counted first. The counts are range-partitioned by
(group, value) into as many parts as their number asks for and sorted there; so many
rows one after the other are a bucket, and a group of any size lies in as many of them
as it fills, while no bucket grows. One small table of sums by group
and bucket tells which bucket holds a wanted rank; only those buckets' rows of the
group are ranked, and the value is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import tables


#: Cells in a range partition, and the bits of the number of cells in a bucket.
PART, BUCKET_BITS = 250_000, 16
#: Buckets that are broadcast; beyond it the join shuffles.
MOST_BROADCAST = 100_000


def _joined(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; ``b``'s keys go."""
    b = b.withColumnsRenamed({n: f"_own_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_own_{n}"))
    return a.join(b, condition, how).drop(*[f"_own_{n}" for n in names])


def _cells(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = [F.count("*").alias("_n")]
    if weight:
        sums.append(F.sum(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("_w"))
    cells = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(*sums)
    # staged, for their number and the bounds' sample each read them
    cells = tables.staged(cells)
    parts = cells.repartitionByRange(cells.count() // PART + 1, *keys, "_v").sortWithinPartitions(*keys, "_v")
    return tables.staged(parts.withColumn("_bucket", F.shiftright(F.monotonically_increasing_id(), BUCKET_BITS)))


def _ranked(cells: DataFrame, keys: list[str], size: str, targets: Column, reaches: bool) -> DataFrame:
    """(keys, _place, _v): for each wanted position the first value whose running size passes it (``reaches``: or equals it).

    ``targets`` is an array of positions made from ``_total``, a group's whole size.
    """
    passes = (lambda run, t: run >= t) if reaches else (lambda run, t: run > t)
    buckets = cells.groupBy(*keys, "_bucket").agg(F.sum(size).alias("_size"))
    # a group has one row here for each bucket it lies in
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    running = F.sum("_size").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    buckets = buckets.withColumns({"_upto": running, "_total": F.sum("_size").over(group)}).withColumn("_before", F.col("_upto") - F.col("_size"))
    wanted = buckets.select("*", F.posexplode(targets).alias("_place", "_target"))
    hit = wanted.filter(passes(F.col("_upto"), F.col("_target")) & ~passes(F.col("_before"), F.col("_target")) & (F.col("_total") > 0))
    hit = hit.groupBy(*keys, "_bucket", "_before").agg(F.collect_list(F.struct("_place", "_target")).alias("_wanted"))
    hit = tables.staged(hit)
    inside = _joined(cells, F.broadcast(hit) if hit.count() <= MOST_BROADCAST else hit, [*keys, "_bucket"]).select(*keys, "_bucket", "_v", F.col(size).alias("_size"), "_before", "_wanted")
    own = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_run", F.col("_before") + F.sum("_size").over(own)).withColumn("_earlier", F.col("_run") - F.col("_size"))
    here = inside.select(*keys, "_v", "_run", "_earlier", F.explode("_wanted").alias("_t"))
    return here.filter(passes(F.col("_run"), F.col("_t._target"))).groupBy(*keys, F.col("_t._place").alias("_place")).agg(F.min("_v").alias("_v"))


def _interpolated(cells: DataFrame, keys: list[str], named: dict[str, float]) -> DataFrame:
    position = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    ends = [f(position(q)).cast("double") for q in named.values() for f in (F.floor, F.ceil)]
    found = _ranked(cells, keys, "_n", F.array(*ends), reaches=False)
    sizes = cells.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    values = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_place") == i, F.col("_v"))).alias(f"_v{i}") for i in range(2 * len(named))])
    out = _joined(values, sizes, keys)
    share = lambda q: position(q) - F.floor(position(q))
    return out.select(*keys, *[(F.col(f"_v{2 * i}") * (1 - share(q)) + F.col(f"_v{2 * i + 1}") * share(q)).alias(name) for i, (name, q) in enumerate(named.items())])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """(keys, one column for each name): quantiles between the two nearest ranks, as ``percentile`` gives them.

    Null and NaN values do not count; a group without any has no row. Null keys are a group.
    """
    return _interpolated(_cells(df, keys, value, None), keys, named)


def summary(df: DataFrame, keys: list[str], value: str, weight: str, named: dict[str, float], out: str = "weighted_median") -> DataFrame:
    """The quantiles, and ``out``: the first value whose running weight reaches half of the group's, the plain median without weight.

    Null and negative weights count as 0. Values are counted and dealt once for both.
    """
    cells = _cells(df, keys, value, weight)
    plain = _interpolated(cells, keys, {**named, "_plain": 0.5})
    half = _ranked(cells.filter("_w > 0"), keys, "_w", F.array(F.col("_total") * 0.5), reaches=True).select(*keys, F.col("_v").alias("_half"))
    return _joined(plain, half, keys, "left").select(*keys, *named, F.coalesce("_half", "_plain").alias(out))
