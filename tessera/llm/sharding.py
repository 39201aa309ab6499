"""Sharding by a keyed permutation of global row numbers.

Rows get gapless global numbers in the order of (doc_id, text hash); a Feistel
network over a domain just above the row count, walked along its cycle until it
lands below the count, permutes them. Place p of N goes to shard p mod S and
slot p div S, so anyone who knows (N, S, seed) computes where a row number went
and, by the inverse, which row holds a slot. Shard sizes differ by one row at
most, whatever the keys or sources: the law is ``rows``.

Defined results: a null text has size 16 and crc32 0; null or repeated doc_ids
get numbers like any other row (repeated rows are interchangeable); an empty
table gives no rows. Equal texts are not kept together under this law.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Radices (a, b) of the Feistel halves: a * b >= n, with less than a points to spare."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _round_value(half: Column, seed: int, j: Column, radix: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(seed).cast("long"), j), F.lit(radix).cast("long"))


def _once(v: Column, a: int, b: int, seed: int, back: bool) -> Column:
    """One pass of the network: left += f(right) on odd rounds, right += f(left) on even ones."""
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")
    sign = -1 if back else 1

    def turn(s, j):
        odd = F.pmod(j, F.lit(2)) == 1
        left = F.when(odd, F.pmod(s["l"] + sign * _round_value(s["r"], seed, j, a), la)).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + sign * _round_value(s["l"], seed, j, b), lb))
        return F.struct(left.alias("l"), right.alias("r"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.struct(F.pmod(v, la).alias("l"), F.call_function("div", v, la).alias("r"))
    return F.aggregate(rounds, start, turn, lambda s: s["r"] * la + s["l"])


def permuted(number: Column, n: int, seed: int = 0, back: bool = False) -> Column:
    """The place in [0, n) of a row number in [0, n); ``back``: the inverse."""
    a, b = domain(n)
    limit = F.lit(n).cast("long")
    first = _once(number, a, b, seed, back)
    if a * b == n:
        return first
    # a walk meets each of the points above the count once at most; one number in about sqrt(n) walks at all
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(a * b - n)),
        first,
        lambda v, _: F.when(v < limit, v).otherwise(_once(v, a, b, seed, back)),
    )
    return F.when(first < limit, first).otherwise(walked)


def shard_table(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, row_number, shard, slot."""
    t = common.text_or_empty(text)
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t).cast("long") + 16).alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.xxhash64(t).alias("_hash"),
    )
    # the place parts even rows that agree in both
    rows = common.numbered(common.with_row_id(slim), ["doc_id", "_hash", "_row"], "row_number").drop("_hash", "_row")
    n = rows.count()
    place = permuted(F.col("row_number"), n, seed)
    total = F.lit(shards).cast("long")
    placed = rows.withColumn("_place", place)
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.pmod("_place", total).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), total).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text") -> tuple[str, str]:
    """Writes whole rows, one folder for each shard, its files in slot order (a shard may be many tasks' work).

    The plan is joined back on (key, hash of the text); rows that agree in both
    are told apart by their order, as they are interchangeable. Returns the names
    of the two new columns: shard and slot, with underscores where the table has such.
    """
    from pyspark.sql import Window

    shard, slot = common.free_name(docs, "shard"), common.free_name(docs, "slot")
    t = common.text_or_empty(text)
    same = Window.partitionBy("_key", "_crc", "_size")
    plan = shard_table(docs, shards, seed, key, text).select(
        F.col("doc_id").alias("_key"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    )
    plan = plan.withColumn("_n", F.row_number().over(same.orderBy("_slot")))
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(key).alias("_key"), F.crc32(t).alias("_crc"), (F.octet_length(t).cast("long") + 16).alias("_size"))
    rows = rows.withColumn("_n", F.row_number().over(same.orderBy(F.xxhash64(F.col(names[text])))))
    on = [rows[c].eqNullSafe(plan[c]) for c in ("_key", "_crc", "_size", "_n")]
    joined = rows.join(plan, on).select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_shard").alias(shard), F.col("_slot").alias(slot))
    joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``rows``."""
    return shard_table(common.read(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


QUERIES = {"op5_feistel_shards": op5_feistel_shards}
ORACLE_SQL: dict[str, str] = {}
