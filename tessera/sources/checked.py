"""Text and JSON sources with their bad rows kept in sight, file formats by extension, and nested API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

CORRUPT = "_corrupt"


def read_checked(spark: SparkSession, paths: str | list[str], schema: T.StructType, kind: str = "csv", columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """Separated text (gzip by extension), several files at once, typed by the reader: the columns, ``_corrupt`` and ``file``.

    A row whose fields do not fit the schema, in number or in type, keeps what could be
    read and has its raw text in ``_corrupt``, whichever ``columns`` are asked for; splits
    of the files replace chunks.
    """
    _, sep = tables.FORMATS[kind]
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(full).csv(paths, header=header, sep=sep, mode="PERMISSIVE", enforceSchema=True, columnNameOfCorruptRecord=CORRUPT)
    names = [f.name for f in schema.fields]
    # a reader that prunes columns sees only the faults of those it reads, so the mark names all
    mark = F.when(F.length(F.concat_ws("", *[F.col(n).cast("string") for n in names])) >= 0, F.col(CORRUPT))
    return raw.select(*(columns or names), mark.alias(CORRUPT), F.col("_metadata.file_name").alias("file"))


def rejected_by_file(checked: DataFrame) -> DataFrame:
    """(file, rows, rejected, the least rejected text). The rows are written first, as the reader gives no rejects without the columns."""
    return tables.staged(checked).groupBy("file").agg(F.count("*").alias("rows"), F.count(CORRUPT).alias("rejected"), F.min(CORRUPT).alias("first_rejected"))


def accepted(checked: DataFrame) -> DataFrame:
    """The good rows, without the marks."""
    return checked.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "file")


def json_records(text: Column) -> Column:
    """The records of a JSON payload as maps: a list of objects, an object with ``rows``, or an object of equally long lists.

    A payload is parsed once for each layout, however many records it has: what a lambda
    names is a value, while an expression inside one is evaluated for each record.
    """
    as_list = F.from_json(text, "array<map<string,string>>")
    as_rows = F.from_json(text, "struct<rows:array<map<string,string>>>")["rows"]
    each = lambda lists, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform_values(lists, lambda _, x: F.get(x, i))))
    longest = lambda lists: F.array_max(F.transform(F.map_values(lists), lambda x: F.size(x)))
    named = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    as_lists = named(F.from_json(text, "map<string,array<string>>"), lambda lists: named(longest(lists), lambda n: each(lists, n)))
    others = named(as_rows, lambda rows: F.coalesce(rows, as_lists))
    return F.when(F.trim(text).startswith("["), as_list).otherwise(others)


def read_json_payloads(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The named columns, as text, of the records in JSON files of any of the three layouts; a file is one payload."""
    whole = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True)
    return whole.select(F.explode(json_records(F.col("value"))).alias("r")).select(*[F.try_element_at("r", F.lit(c)).alias(c) for c in columns])


def read_by_extension(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files and folders of csv, tsv, psv, json payloads and parquet, told apart by their names, as one typed table.

    A name may end in .gz. Columns are aligned by name; a value that does not fit its type is null.
    """
    kinds: dict[str, list[str]] = {}
    for p in paths:
        name = p.rstrip("/").lower().removesuffix(".gz")
        kind = name.rsplit(".", 1)[-1]
        if kind not in tables.FORMATS:
            raise ValueError(f"no reader for {p}")
        kinds.setdefault(kind, []).append(p)
    names, out = [f.name for f in schema.fields], None
    for kind, own in sorted(kinds.items()):
        if kind == "json":
            one = read_json_payloads(spark, own, names)
        else:
            form, sep = tables.FORMATS[kind]
            one = (spark.read.option("sep", sep).option("header", True) if sep else spark.read).format(form).load(own)
        typed = one.select(*[F.col(f.name).cast("string").try_cast(f.dataType).alias(f.name) if f.name in one.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        out = typed if out is None else out.unionByName(typed)
    return out


#: The last two digits of a series id and what they measure.
MEASURES = {"03": "unemployment_rate", "04": "unemployed", "05": "employed", "06": "labour_force"}


def series_measures(df: DataFrame, payload: str, default_year: int | None = None) -> DataFrame:
    """Nested series to one row for each area and year, a column for each measure.

    Yearly averages only; county (CN) and state (ST) areas only; a year that is no number is
    ``default_year`` (without one the value goes); rates become shares; of repeated values of one
    series the first by series id and text stays.
    """
    schema = "struct<Results:struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>>"
    series = df.select(F.explode(F.from_json(F.col(payload), schema)["Results"]["series"]).alias("s")).select("s.seriesID", F.explode("s.data").alias("d"))
    area, code, measure = F.substring("seriesID", 4, 2), F.col("seriesID").substr(F.lit(6), F.length("seriesID") - 7), F.col("seriesID").substr(-2, 2)
    year = F.coalesce(F.col("d.year").try_cast("int"), F.lit(default_year).cast("int"))
    rows = series.filter((F.col("d.period") == "M13") & (F.coalesce(F.col("seriesID"), F.lit("")) != "")).select(
        F.when(area == "CN", "county").when(area == "ST", "state").alias("geography"), F.substring(code, 1, 2).alias("state"),
        F.when(area == "CN", F.substring(code, 1, 5)).alias("county"), year.alias("year"), measure.alias("measure"), "seriesID", F.col("d.value").alias("text"),
    )
    rows = rows.filter("geography is not null and year is not null")
    value = F.col("text").try_cast("double") / F.when(F.col("measure") == "03", 100.0).otherwise(1.0)
    rows = rows.withColumn("value", value)
    first = lambda m: F.min_by("value", F.when((F.col("measure") == m) & F.col("value").isNotNull(), F.struct("seriesID", "text")))
    return rows.groupBy("geography", "state", "county", "year").agg(*[first(m).alias(n) for m, n in MEASURES.items()])
