"""Sources, sinks and incremental loads (S and U families), and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import account, eav
from tessera.sources import tables

from . import base


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 1999 on replace the old rows of those years."""
    o = base.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    old = o.filter("year <= 1999").select("year", "o_orderstatus", "o_totalprice", F.lit("old").alias("batch"))
    new = o.filter("year >= 1999").select("year", "o_orderstatus", F.col("o_totalprice") * 2, F.lit("new").alias("batch")).toDF("year", "o_orderstatus", "o_totalprice", "batch")
    return base.rounded(tables.upserted(old, new).groupBy("year", "batch").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


UPSERT = """WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_totalprice FROM orders), ny AS (SELECT DISTINCT year FROM o WHERE year >= 1999),
u AS (SELECT year, o_totalprice AS p, 'old' AS batch FROM o WHERE year <= 1999 AND year NOT IN (SELECT year FROM ny) UNION ALL SELECT year, o_totalprice * 2, 'new' FROM o WHERE year >= 1999)
SELECT year, batch, count(*) AS n, round(sum(p), 2) AS total FROM u GROUP BY ALL"""


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of 1990-2003 that hold no order of a large amount."""
    held = base.table(spark, sf_dir, "orders").filter("o_totalprice > 300000 and year(o_orderdate) <> 1997").select(F.year("o_orderdate").alias("year"))
    return tables.missing_years(held, 1990, 2003)


MISSING = "SELECT CAST(y AS INT) AS year FROM (SELECT unnest(range(1990, 2004)) AS y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders WHERE o_totalprice > 300000 AND year(o_orderdate) <> 1997)"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each (user, type) wins; its mode, else the type's latest."""
    e = base.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("fetched"), F.col("value").alias("size"), F.when(F.col("event_id") % 3 == 0, "real").alias("mode"))
    last = tables.latest_records(e, ["user_id", "event_type"], [F.desc("fetched")])
    log = e.filter("mode is not null").select("event_type", "mode", "fetched").withColumn("mode", F.when(F.col("fetched") % 2 == 0, "sample").otherwise(F.col("mode")))
    return tables.with_provenance(last, log, "event_type").groupBy("event_type", "mode").agg(F.count("*").alias("n"), F.max("fetched").alias("latest"))


REGISTRY = """WITH l AS (SELECT user_id, event_type, max(event_id) AS fetched FROM events GROUP BY ALL),
g AS (SELECT event_type, arg_max(CASE WHEN event_id % 2 = 0 THEN 'sample' ELSE 'real' END, event_id) AS m FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT event_type, coalesce(CASE WHEN fetched % 3 = 0 THEN 'real' END, m) AS mode, count(*) AS n, max(fetched) AS latest FROM l JOIN g USING (event_type) GROUP BY ALL"""


def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem measures and codes melted, with numeric twins and kinds."""
    df = base.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    long = eav.melted(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"])
    return base.rounded(long.groupBy("column_slug", "value_kind").agg(F.count("*").alias("n"), F.sum("value_numeric").alias("total"), F.max(F.when(F.col("value_kind") == "text", F.col("value_text"))).alias("last_text")), 4)


MELT = """SELECT column_slug, value_kind, count(*) AS n, round(sum(v), 4) AS total, max(t) AS last_text FROM (
  SELECT 'l_quantity' AS column_slug, 'numeric' AS value_kind, l_quantity AS v, NULL AS t FROM lineitem UNION ALL SELECT 'l_discount', 'numeric', l_discount, NULL FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'text', NULL, l_returnflag FROM lineitem UNION ALL SELECT 'l_linestatus', 'text', NULL, l_linestatus FROM lineitem) GROUP BY ALL"""


def header_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed as arrays with a header row per nation, read back by name."""
    c = base.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("bal"))
    one = F.array(F.col("c_custkey").cast("string"), F.col("bal").cast("string"))
    packed = c.groupBy("c_nationkey", (F.col("c_custkey") % 16).alias("part")).agg(F.to_json(F.concat(F.array(F.array(F.lit("KEY"), F.lit("BAL"))), F.collect_list(one))).alias("payload"))
    rows = tables.header_rows(packed, "payload", ["KEY", "BAL", "NONE"])
    return base.rounded(rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("KEY").try_cast("long")).alias("keys"), F.sum(F.col("BAL").try_cast("double") * 1000).alias("total"), F.count("NONE").alias("absent")), 2)


HEADER = "SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(round(c_acctbal, 2) * 1000), 2) AS total, 0 AS absent FROM customer GROUP BY ALL"


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parsed event properties by type and month."""
    e = base.table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return base.rounded(e.groupBy("event_type", F.month("ts").alias("month")).agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.avg("value").alias("mean")))


PROPS = "SELECT event_type, CAST(month(ts) AS INT) AS month, count(CAST(props->>'k' AS INT)) AS n, CAST(sum(CAST(props->>'k' AS INT)) AS BIGINT) AS k_sum, round(avg(value), 6) AS mean FROM events GROUP BY ALL"


def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred order of each customer and year by priority; how many are duplicates."""
    o = base.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    rank = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(3)
    picked = eav.best_source(o, ["o_custkey", "year"], rank, "o_orderkey")
    return picked.groupBy("year", "pick", "priority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


PREFERRED = """WITH r AS (SELECT *, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END AS priority FROM orders),
p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey, year ORDER BY priority, o_orderkey) = 1 THEN 'preferred' ELSE 'duplicate_nonpreferred' END AS pick FROM r)
SELECT year, pick, priority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM p GROUP BY ALL"""


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from names: digits, padding, slugs, keys, series ids."""
    n = base.table(spark, sf_dir, "customer").select("c_name", "c_nationkey").withColumn("code", S.coerced_code("c_name", 5))
    out = n.select(
        "code", S.padded_code("c_nationkey", 2).alias("state"), S.slug("c_name").alias("slug"), S.state_of_county("code").alias("prefix"),
        S.text_token(F.concat("c_name", F.lit("  X"))).alias("token"), S.county_key(F.concat(F.lit("Saint "), "c_name", F.lit(" County"))).alias("county"),
        S.series_id("UCN", "c_nationkey", F.lit("3")).alias("series"), S.resolved_key(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), {f"N{i}": f"{i:02d}" for i in range(20)}).alias("resolved"),
    )
    return out.distinct()


CROSSWALK = """SELECT DISTINCT lpad(right(regexp_replace(c_name, '\\D', '', 'g'), 5), 5, '0') AS code, lpad(c_nationkey::VARCHAR, 2, '0') AS state,
  trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, left(lpad(right(regexp_replace(c_name, '\\D', '', 'g'), 5), 5, '0'), 2) AS prefix,
  lower(c_name) || ' x' AS token, 'st ' || regexp_replace(lower(c_name), '[^a-z0-9 ]', '', 'g') AS county,
  'LAUCN' || lpad(c_nationkey::VARCHAR, 13, '0') || '03' AS series, CASE WHEN c_nationkey < 20 THEN lpad(c_nationkey::VARCHAR, 2, '0') END AS resolved FROM customer"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money with suffixes, accounting numbers, counts, shares, yes/no, years, ranges over table values."""
    li = base.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", F.year("l_shipdate").alias("y"))
    q = F.col("l_quantity").cast("int")
    text = F.concat(q.cast("string"), F.when(q % 3 == 0, "K").when(q % 3 == 1, "M").otherwise("x"))
    paren = F.when(q % 2 == 0, F.concat(F.lit("($1,"), F.lpad(q.cast("string"), 3, "0"), F.lit(")"))).when(q % 5 == 0, "-").otherwise(F.concat(q.cast("string"), F.lit("%")))
    rows = li.withColumns({
        "money": S.magnitude_money(text), "account": S.accounting_number(paren), "supp": S.suppressed_count(F.when(q % 4 == 0, "Suppressed").otherwise(F.concat(q.cast("string"), F.lit("*")))),
        "note": S.suppression_note(F.when(q % 4 == 0, "Suppressed").otherwise("7")), "sh": S.share(q * 3), "yes": S.yes_no(F.when(q % 2 == 0, "Yes").otherwise("2")),
        "yr": S.year_in(F.concat(F.lit("FY"), F.col("y").cast("string"))), "span": F.size(S.effective_years(F.col("y"), F.when(q % 2 == 0, F.col("y") + q % 7).otherwise(2999), F.lit(2002))),
        "neg": S.not_negative(q - 25), "same": S.close(F.col("l_discount"), F.col("l_discount") * (1 + 1e-7)),
    })
    return base.rounded(rows.groupBy("l_returnflag").agg(
        F.sum("money").alias("money"), F.sum("account").alias("account"), F.sum("supp").alias("supp"), F.count("note").alias("notes"), F.sum("sh").alias("shares"),
        F.count_if("yes").alias("yes"), F.count("yr").alias("years"), F.sum("span").alias("spans"), F.sum("neg").alias("neg"), F.bool_and("same").alias("same"),
    ), 4)


NUMBERS = """WITH l AS (SELECT *, CAST(l_quantity AS INT) AS q, CAST(year(l_shipdate) AS INT) AS y FROM lineitem)
SELECT l_returnflag, round(sum(CASE q % 3 WHEN 0 THEN q * 1e3 WHEN 1 THEN q * 1e6 ELSE 0 END), 4) AS money,
  round(sum(CASE WHEN q % 2 = 0 THEN -(1000 + q) WHEN q % 5 = 0 THEN NULL ELSE q END)::DOUBLE, 4) AS account, round(sum(CASE WHEN q % 4 <> 0 THEN q END)::DOUBLE, 4) AS supp, count(*) FILTER (q % 4 = 0) AS notes,
  round(sum(CASE WHEN q * 3 > 100 THEN NULL WHEN q * 3 > 1 THEN q * 3 / 100.0 ELSE q * 3 END)::DOUBLE, 4) AS shares, count(*) FILTER (q % 2 = 0) AS yes, count(*) FILTER (y >= 2000) AS years,
  CAST(sum(CASE WHEN q % 2 = 0 THEN q % 7 + 1 WHEN 2002 < y THEN 1 ELSE 2002 - y + 1 END) AS BIGINT) AS spans, round(sum(greatest(q - 25, 0))::DOUBLE, 4) AS neg, true AS same FROM l GROUP BY ALL"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of labels built from order fields, with counts and shares."""
    o = base.table(spark, sf_dir, "orders")
    label = S.label_of(F.col("o_orderstatus"), {"F": "explicit_sheet", "O": "proxy_share"}, "inferred_complement")
    status = F.concat(label, F.when(F.col("o_orderkey") % 7 == 0, "_downgraded").otherwise(""))
    return base.rounded(account.support_counts(o.withColumn("status", status), "status", ["o_orderpriority"]))


TIERS = """WITH s AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'explicit' WHEN 'O' THEN 'proxy' ELSE 'inferred' END AS t, o_orderkey FROM orders),
c AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN 'proxy' ELSE t END AS support_tier, count(*) AS n FROM s GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM c"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, positions, types and non-null rows of the artifacts."""
    names = ("nation", "customer", "orders", "part")
    out = account.schema_inventory({n: base.table(spark, sf_dir, n) for n in names})
    return out.select("artifact", "column_name", "position", "row_count", "non_null_rows")


_COLS = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}
INVENTORY = " UNION ALL ".join(f"SELECT '{t}' AS artifact, '{c}' AS column_name, {i} AS position, count(*) AS row_count, count({c}) AS non_null_rows FROM {t}" for t, cs in _COLS.items() for i, c in enumerate(cs))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grain, key role, nullability, meaning, unit of every column."""
    names = ("nation", "customer", "orders", "part")
    inv = account.schema_inventory({n: base.table(spark, sf_dir, n) for n in names})
    return account.contract(inv, {"nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"]})


_GRAIN = "CASE artifact WHEN 'nation' THEN 'n_nationkey' WHEN 'customer' THEN 'c_custkey' WHEN 'orders' THEN 'o_orderkey' ELSE 'p_partkey' END"
_KIND = """CASE WHEN regexp_matches(column_name, '(^|_)(key|id|code|fips)$|key$') THEN 'identifier' WHEN regexp_matches(column_name, 'year|date|(^|_)ts$') THEN 'time' WHEN regexp_matches(column_name, 'price|cost|wage|acctbal|tax|value') THEN 'money'
  WHEN regexp_matches(column_name, 'share|rate|discount|ratio') THEN 'share' WHEN regexp_matches(column_name, 'count|^n_|number|quantity|size') THEN 'quantity' WHEN regexp_matches(column_name, 'status|flag|type|segment|priority|label') THEN 'category' ELSE 'text' END"""
CONTRACT = f"""WITH i AS ({INVENTORY}), k AS (SELECT *, {_KIND} AS semantic_type FROM i)
SELECT artifact, column_name, {_GRAIN} AS grain, column_name = {_GRAIN} AS is_key, non_null_rows < row_count AS nullable, semantic_type,
  CASE semantic_type WHEN 'money' THEN 'dollars' WHEN 'share' THEN 'fraction' WHEN 'quantity' THEN 'count' WHEN 'time' THEN 'calendar' ELSE 'none' END AS unit FROM k"""

REGISTERED = {
    "year_upsert": (upsert, UPSERT), "missing_years": (missing, MISSING), "source_registry": (registry, REGISTRY), "melt_to_eav": (melt, MELT), "header_json_rows": (header_json, HEADER),
    "event_properties": (props, PROPS), "preferred_source": (preferred, PREFERRED), "code_crosswalk": (crosswalk, CROSSWALK), "number_parsing": (numbers, NUMBERS), "support_tiers": (tiers, TIERS),
    "schema_inventory": (inventory, INVENTORY), "data_contract": (contract, CONTRACT),
}
