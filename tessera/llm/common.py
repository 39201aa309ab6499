"""Helpers shared by the training-data operators: reading, staging, row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a folder of this machine serves, but only with a local
    master; a cluster without the setting is an error, not a silent local path.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    Cuts the lineage and freezes what is not deterministic: a lost executor
    costs a reread, never another outcome.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes a staged frame's files; nothing may read it any more."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch("[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A long that tells rows apart, repeated ones too.

    The number follows from the input split and the place in it, so ``df`` must
    be read from files (or staged): then every scan of it gives the same ids.
    Splits also depend on how many cores the cluster has just now, unless
    spark.sql.files.minPartitionNum is set; it is pinned here, so that a lost
    executor between two scans moves no row.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Gapless global numbers from 0 in the given order, without a single-task sort.

    Rows are range-partitioned, sorted in their partition and staged with
    (partition, place); a prefix sum over the partitions' counts does the rest.
    The broadcast side has one row for each partition.
    """
    cols = [F.col(c) for c in order]
    parts = staged(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", _PARTITION_SHIFT)
    from pyspark.sql import Window

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(part.alias("_p"))
        .agg(F.count("*").alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_m").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        parts.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_before") + place)
        .drop("_p", "_m", "_before")
    )


#: A key with more than one in so many of all rows is hot; fewer keys than this can be.
HOT = 1000


def join_groups(rows: DataFrame, side: DataFrame, on: list[str], hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key; no task gets all rows of a hot key.

    Both should be staged, for they are read more than once. Keys that hold more than
    one in ``HOT`` of the rows, fewer than ``HOT`` by count, are broadcast; the rest
    is joined by Spark's choice. ``hot`` has their keys where the caller knows them.
    """
    if hot is None:
        hot = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT > rows.count()).select(*on)
    hot = F.broadcast(staged(hot))
    few = F.broadcast(side.join(hot, on, "left_semi"))
    return rows.join(hot, on, "left_semi").join(few, on, how).unionByName(rows.join(hot, on, "left_anti").join(side, on, how))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def filter_after(df: DataFrame, condition: Column) -> DataFrame:
    """Filters on computed columns, after they are computed.

    A plain filter is pushed below the projections with their expressions copied
    into it; an array that a lambda looks up would then be made anew for each
    element. A mark that is not deterministic keeps the filter in its place.
    """
    mark = free_name(df, "_mark")
    return df.withColumn(mark, F.monotonically_increasing_id()).filter(condition & (F.col(mark) >= 0)).drop(mark)
