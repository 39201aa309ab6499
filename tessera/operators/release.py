"""Support tables of one schema, a bundle of written artifacts, and its index with existence and SHA-256."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.sources import tables

#: The columns of every support table.
SUPPORT = ["table_name", "component", "label", "rows", "eligible"]


def support_table(name: str, df: DataFrame, component: str, label: str, eligible: str | None = None) -> DataFrame:
    """One support table: rows of each label within a component, and how many of them are eligible."""
    return df.groupBy(F.col(component).cast("string").alias("component"), F.col(label).cast("string").alias("label")).agg(
        F.count("*").alias("rows"), (F.count_if(F.col(eligible)) if eligible else F.count("*")).alias("eligible")
    ).select(F.lit(name).alias("table_name"), "component", "label", "rows", "eligible")


def support_tables(status: DataFrame, controls: DataFrame, names: list[str], promoted: float = 0.75) -> DataFrame:
    """Support quality by component, the mix of support statuses with eligibility, and policy coverage, as one table.

    ``status``: component, place, status and fallback; ``controls``: one row for each place with the ``names`` as columns.
    """
    tiers = status.withColumn("tier", S.support_tier("status")).withColumn("eligible", F.col("tier").isin("explicit", "inferred") & ~F.col("fallback"))
    quality = support_table("support_quality_summary", tiers, "component", "tier")
    mix = support_table("support_mix_summary", tiers, "tier", "status", "eligible")
    counted = controls.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in names]).unpivot(["n"], names, "component", "known")
    reaches = F.col("known") >= promoted * F.col("n")
    policy = counted.select(
        F.lit("policy_coverage_summary").alias("table_name"), "component", F.when(reaches, "promoted").otherwise("sparse").alias("label"), F.col("n").alias("rows"), F.col("known").alias("eligible")
    )
    return quality.unionByName(mix).unionByName(policy)


def write_artifact(df: DataFrame, folder: str, name: str, order: list[str]) -> str:
    """A small report table as one CSV file in a folder of its own, rows in order, so that equal tables are equal bytes.

    Report tables have a row for each component and label; larger ones belong in Parquet by ``write.parquet``.
    """
    path = f"{folder}/{name}"
    df.repartition(1).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)
    return path


def bundle_index(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every artifact of the manifest with ``file_exists``, ``n_files``, ``n_bytes`` and ``sha256`` (empty if absent).

    ``manifest``: artifact, group, kind, tier. An artifact is a folder below ``folder``; its digest is that of
    its file, or of its files' digests in order of their names where there are several.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    parts = files.select(F.element_at(F.split("path", "/"), -2).alias("artifact"), "path", "length", F.sha2("content", 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: x["digest"])
    found = parts.groupBy("artifact").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), ordered.alias("_d"))
    one = F.when(F.col("n_files") == 1, F.element_at("_d", 1)).otherwise(F.sha2(F.array_join("_d", ""), 256))
    found = found.select("artifact", "n_files", "n_bytes", one.alias("sha256"))
    rows = manifest.join(found, "artifact", "left").withColumn("file_exists", F.col("sha256").isNotNull())
    return rows.fillna({"n_files": 0, "n_bytes": 0, "sha256": ""})


def write_bundle(spark: SparkSession, artifacts: dict[str, tuple[DataFrame, list[str]]], manifest: DataFrame, folder: str) -> DataFrame:
    """Writes every artifact and the index of the bundle; the index is read back. An artifact of the manifest that is not given stays absent."""
    for name, (df, order) in artifacts.items():
        write_artifact(df, folder, name, order)
    index = tables.staged(bundle_index(spark, manifest, folder))
    index.withColumn("place", F.row_number().over(Window.orderBy("group", "artifact"))).repartition(1).sortWithinPartitions("place").write.mode("overwrite").json(f"{folder}/_index")
    return index
