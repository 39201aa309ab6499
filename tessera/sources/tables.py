"""Readers, sinks, staging, upserts, registries and manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": ("csv", ","), "tsv": ("csv", "\t"), "psv": ("csv", "|"), "json": ("json", None), "parquet": ("parquet", None)}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a folder of this machine only where the master is local and none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_text_table(spark: SparkSession, paths: str | list[str], schema: T.StructType, kind: str = "csv", columns: list[str] | None = None) -> DataFrame:
    """CSV, TSV or pipe-separated files (gzip by extension), several at once, all as text first; short and trailing rows give nulls."""
    _, sep = FORMATS[kind]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).csv(paths, header=True, sep=sep, mode="PERMISSIVE", enforceSchema=True)
    typed = raw.select(*[F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return typed.select(*columns) if columns else typed


def without_trailer(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Drops footers and other rows whose key has not the code's form."""
    return df.filter(F.col(key).cast("string").rlike(pattern))


def read_any(spark: SparkSession, by_kind: dict[str, list[str]]) -> DataFrame:
    """Files of several formats as one table, columns aligned by name."""
    out = None
    for kind, paths in by_kind.items():
        form, sep = FORMATS[kind]
        reader = spark.read.format(form)
        if sep:
            reader = reader.option("sep", sep).option("header", True)
        one = reader.load(paths)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def header_rows(df: DataFrame, payload: str, columns: list[str]) -> DataFrame:
    """An array of arrays whose first row is the header, to one row per record with the named columns."""
    rows = F.from_json(F.col(payload), "array<array<string>>")
    parsed = df.withColumn("_rows", rows).withColumn("_head", F.get(F.col("_rows"), F.lit(0)))
    each = parsed.select(*[c for c in df.columns if c != payload], "_head", F.posexplode(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("row", "_r"))
    values = F.map_from_arrays("_head", "_r")
    return each.withColumn("_m", values).select(*[c for c in df.columns if c != payload], "row", *[F.try_element_at("_m", F.lit(c)).alias(c) for c in columns])


def series_rows(df: DataFrame, payload: str) -> DataFrame:
    """Nested series of yearly data to rows; yearly averages (M13) only."""
    schema = "struct<Results:struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>>"
    s = df.select(F.explode(F.from_json(F.col(payload), schema)["Results"]["series"]).alias("s")).select("s.seriesID", F.explode("s.data").alias("d"))
    return s.filter(F.col("d.period") == "M13").select("seriesID", F.col("d.year").try_cast("int").alias("year"), F.col("d.value").try_cast("double").alias("value"))


def upserted(old: DataFrame, new: DataFrame, key: str = "year") -> DataFrame:
    """Rows of the new batch replace all old rows of its years."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_years(df: DataFrame, path: str, key: str = "year") -> None:
    """As a sink: only the partitions of the years at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def missing_years(held: DataFrame, first: int, last: int, key: str = "year") -> DataFrame:
    """Years of the range that are not held."""
    wanted = held.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(key))
    return wanted.join(held.select(F.col(key).cast("int").alias(key)).distinct(), key, "left_anti")


def latest_records(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key wins."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return records.withColumn("_n", n).filter("_n = 1").drop("_n")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, extension, size and time of every file, without reading any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"), "length", "modificationTime")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file; for artifacts of moderate size, as each is read as one value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def write_json_summary(df: DataFrame, path: str) -> None:
    """Records as JSON lines, columns in sorted order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_json_summary(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S3: the records of a summary, typed by the given schema; fields that a record lacks are null."""
    return spark.read.schema(schema).json(path)


def with_provenance(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Each artifact's mode from its own record, else the registry's latest."""
    latest = registry.groupBy(key).agg(F.max_by("mode", "fetched").alias("_mode"))
    return df.join(latest, key, "left").withColumn("mode", F.coalesce("mode", "_mode")).drop("_mode")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails at plan time if a column is missing; reads no data."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, column: str, default) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(default))
