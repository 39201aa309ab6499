"""Report tables over channel scenarios, support labels and rules; and the normalisers of demographic, birth and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

TIERS = ("explicit", "inferred", "proxy", "missing")


def elasticity_map(spark: SparkSession, families: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(channel, family, demand_elasticity, supply_elasticity) as a literal table."""
    return spark.createDataFrame([(c, *x) for c, x in families.items()], "channel string, family string, demand_elasticity double, supply_elasticity double")


def segment_support(prices: DataFrame, places: DataFrame, keys: list[str], segment: str, least: int = 3) -> DataFrame:
    """Priced segments of each place and year, and a status; places without any are kept."""
    n = prices.groupBy(*keys).agg(F.count_distinct(segment).alias("n_segments"))
    out = places.select(*keys).distinct().join(n, keys, "left").fillna(0, ["n_segments"])
    return out.withColumn("status", F.when(F.col("n_segments") >= least, "supported").when(F.col("n_segments") > 0, "thin").otherwise("missing"))


def channel_response(rows: DataFrame) -> DataFrame:
    """By channel and alpha: quantities before and after, their difference and share, and whether the price stayed."""
    out = rows.groupBy("channel", "alpha").agg(F.sum("market").alias("base_quantity"), F.sum("quantity").alias("quantity"), F.bool_and(F.abs(F.col("price") - F.col("base_price")) < 1e-9).alias("price_invariant"), F.count("*").alias("n"))
    delta = F.col("quantity") - F.col("base_quantity")
    return out.withColumns({"delta": delta, "change": F.try_divide(delta, F.nullif(F.col("base_quantity"), F.lit(0.0)))})


def with_defaults(df: DataFrame, other: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """A left join whose missing values get typed defaults."""
    return df.join(other, keys, "left").fillna(defaults)


def channel_shares(rows: DataFrame, keys: list[str], paid: list[str]) -> DataFrame:
    """Channel quantities of a place and year with their share of the paid total."""
    total = F.sum(F.when(F.col("channel").isin(paid), F.col("quantity")).otherwise(0.0)).over(Window.partitionBy(*keys))
    share = F.when(F.col("channel").isin(paid), F.try_divide(F.col("quantity"), F.nullif(total, F.lit(0.0))))
    return rows.withColumn("paid_share", share)


def keyword_tier(status: Column) -> Column:
    """The tier that a status text names, the first of the list that is in it."""
    out = F.when(F.lit(False), F.lit(""))
    for tier in TIERS:
        out = out.when(F.lower(status).contains(tier), F.lit(tier))
    return out.otherwise("missing")


def tier_rank(tier: Column) -> Column:
    """O3: explicit first."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier), F.lit(0)), F.lit(len(TIERS)))


def quality_by_tier(df: DataFrame, tier: str, fallback: str) -> DataFrame:
    """Rows, share, fallback rows of each tier."""
    out = df.groupBy(tier).agg(F.count("*").alias("n"), F.count_if(F.col(fallback)).alias("n_fallback"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def issue_label(tier: Column, fallback: Column, gap: Column, large: float) -> Column:
    """The main issue of a row."""
    return F.when(tier == "missing", "missing_support").when(gap > large, "large_gap").when(tier == "proxy", "proxy_support").when(fallback, "fallback").otherwise("none")


def issue_breakdown(df: DataFrame, issue: str, place: str) -> DataFrame:
    """Rows and places of each issue."""
    return df.groupBy(issue).agg(F.count("*").alias("n_rows"), F.count_distinct(place).alias("n_places"))


def focus_targets(files: DataFrame, file: str, words: str, wanted: list[str]) -> DataFrame:
    """Per file the wanted words it has and lacks, as sorted texts."""
    want = F.array(*[F.lit(w) for w in sorted(wanted)])
    own = files.groupBy(file).agg(F.collect_set(words).alias("_own"))
    matched, missing = F.array_intersect(want, "_own"), F.array_except(want, "_own")
    return own.select(file, F.array_join(matched, "|").alias("matched"), F.array_join(missing, "|").alias("missing"), F.size(missing).alias("n_missing"))


def parse_inventory(raw: DataFrame, keys: list[str], parsed: Column) -> DataFrame:
    """Raw and parsed rows of each file or sheet, and a status."""
    out = raw.groupBy(*keys).agg(F.count("*").alias("raw_rows"), F.count_if(parsed).alias("parsed_rows"))
    status = F.when(F.col("parsed_rows") == 0, "empty").when(F.col("parsed_rows") < F.col("raw_rows"), "partial").otherwise("parsed")
    return out.withColumn("status", status)


def demographics(df: DataFrame, male: str, female: str, one_parent: str, employed: list[str]) -> DataFrame:
    """Children as a sum of both sexes, the one-parent share and the employment rate; a zero denominator gives null."""
    under = F.col(male) + F.col(female)
    base = F.nullif(under, F.lit(0.0))
    return df.withColumns({"children": under, "one_parent_share": F.col(one_parent) / base, "employment_rate": sum((F.col(c) for c in employed), F.lit(0.0)) / base})


def births(df: DataFrame, code: str, value: str) -> DataFrame:
    """Rows with a well-formed five-digit code; the count without thousands' marks and asterisks, and whether it was suppressed."""
    text = F.regexp_replace(F.col(value), r"[,*\s]", "")
    suppressed = F.lower(F.col(value)).contains("suppress")
    return df.filter(F.col(code).rlike("^[0-9]{5}$")).select("*", text.try_cast("double").alias("births"), suppressed.alias("suppressed"))


def rule_level(df: DataFrame, values: list[str], keys: list[str], order: str) -> DataFrame:
    """The first numeric of several value columns; of repeated keys the last row stays."""
    value = F.coalesce(*[F.col(c).try_cast("double") for c in values])
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("value", value).withColumn("_n", n).filter("_n = 1").drop("_n")


def wide_rules(df: DataFrame, keys: list[str], rules: list[str], order: str) -> DataFrame:
    """Rule columns as numbers, one row for each place and year (the first)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", n).filter("_n = 1").select(*keys, *[F.col(c).try_cast("double").alias(c) for c in rules])


def with_place_and_year(df: DataFrame, places: list[Column], years: list[Column], names: DataFrame, width: int = 2) -> DataFrame:
    """``place``: the first candidate that is digits or a known name; ``found_year``: the first with a year in it.

    ``names``: name and code, any number of them, in any case; of equal names the least code counts.
    """
    known = names.groupBy(F.upper(F.trim("name")).alias("_name")).agg(F.min("code").alias("_code"))
    codes = []
    for i, p in enumerate(places):
        text = F.upper(F.trim(p.cast("string")))
        df = df.withColumn(f"_p{i}", text).join(known.withColumnsRenamed({"_name": f"_p{i}", "_code": f"_c{i}"}), f"_p{i}", "left")
        codes.append(F.coalesce(F.when(F.col(f"_p{i}").rlike(r"^\d+$"), S.padded_code(f"_p{i}", width)), F.col(f"_c{i}")))
    own = [f"_{x}{i}" for i in range(len(places)) for x in "pc"]
    return df.withColumns({"place": F.coalesce(*codes), "found_year": S.year_in(*years)}).drop(*own)


def proxy_gaps(df: DataFrame, proxy: str, known: str, large: float) -> DataFrame:
    """Rows with both values, their gap, its share of the known one, and whether it is large; largest first by rank."""
    gap = F.col(proxy) - F.col(known)
    rows = df.filter(F.col(proxy).isNotNull() & F.col(known).isNotNull()).withColumns({"gap": gap, "gap_share": F.try_divide(F.abs(gap), F.nullif(F.abs(known), F.lit(0.0)))})
    return rows.withColumn("size", F.when(F.col("gap_share") > large, "large").otherwise("small"))
