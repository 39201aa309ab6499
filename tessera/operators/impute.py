"""Imputation ladders: group-median ratios and labelled fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import tables

from . import quantiles


def fill_from_group_medians(df: DataFrame, value: str, base: str, label: str, levels: list[tuple[str, list[str]]], exact: str = "observed") -> DataFrame:
    """Missing values become base * the median observed ratio of the first level that has one.

    The ratio is taken once, over observed positive pairs, before any fill. All
    levels' medians come from one distributed selection over (level, keys), so
    even the level without keys is no one task's work; each is then as many rows
    as the level has groups. ``levels``: (name, keys), finest first.
    """
    ratio = F.when((F.col(value) > 0) & (F.col(base) > 0), F.col(value) / F.col(base))
    names = sorted({k for _, keys in levels for k in keys})
    types = dict(df.dtypes)
    own = [F.struct(F.lit(i).alias("_level"), *[(F.col(k) if k in keys else F.lit(None).cast(types[k])).alias(k) for k in names]) for i, (_, keys) in enumerate(levels)]
    pairs = df.select(ratio.alias("_ratio"), F.explode(F.array(*own)).alias("_l")).filter("_ratio is not null").select("_ratio", "_l.*")
    found = tables.staged(quantiles.exact_quantiles(pairs, ["_level", *names], "_ratio", {"_m": 0.5}))
    rows, known = df, []
    for i, (_, keys) in enumerate(levels):
        medians = found.filter(F.col("_level") == i).select(*keys, F.col("_m").alias(f"_m{i}"))
        rows = rows.join(medians, keys, "left") if keys else rows.join(F.broadcast(medians), F.lit(True), "left")
        known.append(F.col(f"_m{i}"))
    need = F.col(value).isNull() & F.col(base).isNotNull()
    named = F.when(F.col(value).isNotNull(), exact)
    for (name, _), m in zip(levels, known, strict=True):
        named = named.when(need & m.isNotNull(), name)
    filled = F.coalesce(F.col(value), F.col(base) * F.coalesce(*known))
    out = rows.withColumns({label: named.otherwise("missing"), value: filled})
    return out.drop(*[f"_m{i}" for i in range(len(levels))])


def first_of(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first candidate that is not null, and its name (P4's ladder)."""
    label = F.when(candidates[0][1].isNotNull(), candidates[0][0])
    for name, c in candidates[1:]:
        label = label.when(c.isNotNull(), name)
    return F.coalesce(*[c for _, c in candidates]), label.otherwise("missing")
