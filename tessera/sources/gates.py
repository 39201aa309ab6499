"""What mode an artifact was built in, and a refusal inside the plan where a job needs real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REAL, SAMPLE = "real", "sample"


def refusals(required: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """(key, command, reason) of every required artifact that is missing, built from samples, or without a mode.

    ``required``: key and the command that builds it; ``provenance``: key and mode, one row for each artifact.
    """
    own = provenance.select(key, "mode").withColumn("_has", F.lit(1))
    rows = required.join(own, key, "left")
    reason = F.when(F.col("_has").isNull(), "missing").when(F.col("mode").isNull(), "unlabelled").when(F.col("mode") == SAMPLE, "sample").when(F.col("mode") != REAL, "unknown_mode")
    return rows.withColumn("reason", reason).filter("reason is not null").select(key, "command", "reason")


def require_real(df: DataFrame, required: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """``df``, unless a required artifact is refused: then the first action on it fails and names them all.

    The check is a part of the plan: one row that is joined to the data, so nothing is computed past a refusal.
    """
    found = refusals(required, provenance, key)
    each = F.concat_ws(" ", F.col(key).cast("string"), F.concat(F.lit("is "), F.col("reason"), F.lit(": run")), "command")
    text = found.agg(F.array_join(F.array_sort(F.collect_list(each)), "; ").alias("_why"))
    stop = F.when(F.col("_why") == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("artifacts are refused: "), F.col("_why"))).cast("boolean"))
    gate = text.select(stop.alias("_passed"))
    return df.crossJoin(F.broadcast(gate)).filter("_passed").drop("_passed")
