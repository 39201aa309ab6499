"""Sources and sinks that are written from the given tables and read back (S2-S9, S11, S12, S14, S17, S20-S22), policies by date (C9), curves (E20, E21) and the release bundle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import policies, release, scenario
from tessera.sources import checked, gates, tables
from tessera.streaming import upserts

from . import base, identification, models


def _folder(spark: SparkSession) -> str:
    return f"{tables.shared_dir(spark)}/{uuid.uuid4().hex}"


def year_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly partitions from a stream of two batches of orders, the second of which brings its years anew; then that batch once more, as after a failure."""
    o = base.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    old, new = o.filter("year <= 1999").withColumn("batch", F.lit(1)), o.filter("year >= 1999").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("batch", F.lit(2))
    folder = _folder(spark)
    for batch in (old, new):
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
        upserts.replace_years(stream, f"{folder}/out", f"{folder}/progress", once=True).awaitTermination()
    tables.write_years(new, f"{folder}/out")
    back = spark.read.schema("o_orderkey long, o_totalprice double, batch int, year int").parquet(f"{folder}/out")
    return base.rounded(back.groupBy("year", "batch").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderkey").alias("first_key")), 2)


YEAR_PARTITIONS = """WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey, o_totalprice FROM orders)
SELECT year, CASE WHEN year >= 1999 THEN 2 ELSE 1 END AS batch, count(*) AS n, round(sum(CASE WHEN year >= 1999 THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS total, min(o_orderkey) AS first_key FROM o GROUP BY ALL"""

_LINE = T.StructType([T.StructField("key", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("quantity", T.DoubleType()), T.StructField("price", T.DoubleType()), T.StructField("status", T.StringType())])
#: Return flag to format and compression.
_TEXTS = {"A": ("csv", "none"), "N": ("psv", "gzip"), "R": ("tsv", "none")}


def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as comma, pipe (gzipped) and tab separated files with damaged rows among them, read back with their types: rows, rejected ones and sums of the good ones by format."""
    li = base.table(spark, sf_dir, "lineitem")
    # a line of seven has text for its quantity, one of six with an odd order lacks fields
    quantity = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    short = (F.col("l_linenumber") == 6) & (F.col("l_orderkey") % 2 == 1)
    folder, out = _folder(spark), None
    for flag, (kind, packed) in _TEXTS.items():
        sep = tables.FORMATS[kind][1]
        fields = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), quantity, F.col("l_extendedprice").cast("string"), F.col("l_linestatus")]
        text = F.when(short, F.concat_ws(sep, *fields[:3])).otherwise(F.concat_ws(sep, *fields))
        li.filter(F.col("l_returnflag") == flag).select(text.alias("value")).write.option("compression", packed).text(f"{folder}/{kind}")
        # no header was written, so a reader of whole folders needs none
        rows = checked.read_checked(spark, f"{folder}/{kind}", _LINE, kind, header=False).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    good = F.col(checked.CORRUPT).isNull()
    own = lambda c: F.sum(F.when(good, F.col(c)))
    done = tables.staged(out).groupBy("kind").agg(
        F.count("*").alias("rows"), F.count(checked.CORRUPT).alias("rejected"), (F.count_distinct("file") > 0).alias("has_files"), F.count_if(F.col("file").endswith(".gz")).alias("from_gzip"),
        own("quantity").alias("quantity"), own("price").alias("price"), F.count_distinct(F.when(good, F.col("status"))).alias("statuses"),
    )
    return base.rounded(done, 2)


TEXT_TABLES = """WITH l AS (SELECT *, l_linenumber = 7 OR (l_linenumber = 6 AND l_orderkey % 2 = 1) AS bad, CASE l_returnflag WHEN 'A' THEN 'csv' WHEN 'N' THEN 'psv' ELSE 'tsv' END AS kind FROM lineitem)
SELECT kind, count(*) AS rows, count(*) FILTER (bad) AS rejected, true AS has_files, count(*) FILTER (kind = 'psv') AS from_gzip, round(sum(l_quantity) FILTER (NOT bad), 2) AS quantity, round(sum(l_extendedprice) FILTER (NOT bad), 2) AS price,
  count(DISTINCT l_linestatus) FILTER (NOT bad) AS statuses FROM l GROUP BY kind"""

_PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_type", T.StringType()), T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])
#: Fixed value: keys of one JSON payload's range; a layout holds one in six of them.
_PAYLOAD_KEYS = 16384


def formats_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt to a CSV, a gzipped TSV, a Parquet folder and JSON payloads of three layouts, told apart by name and read as one table."""
    p = base.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    folder, k = _folder(spark), F.pmod(F.xxhash64("p_partkey"), F.lit(6))
    own = lambda i: p.filter(k == i)
    own(0).drop("p_size").write.option("header", True).csv(f"{folder}/a.csv")
    own(1).write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{folder}/b.tsv.gz")
    own(2).write.parquet(f"{folder}/c.parquet")
    # a payload is one file and one value, so it takes a range of keys: more parts give more payloads, not longer ones
    packed = lambda i, c: own(i).groupBy(F.floor(F.col("p_partkey") / _PAYLOAD_KEYS).alias("g")).agg(c.alias("value"))
    whole = F.struct(*p.columns)
    of = lambda c: lambda x: x[c]
    layouts = {
        3: F.to_json(F.collect_list(whole)), 4: F.to_json(F.struct(F.collect_list(whole).alias("rows"))),
        5: F.to_json(F.struct(*[F.transform(F.array_sort(F.collect_list(whole)), of(c)).alias(c) for c in p.columns])),
    }
    for i, c in layouts.items():
        packed(i, c).write.partitionBy("g").text(f"{folder}/{'def'[i - 3]}.json")
    paths = [f"{folder}/{n}" for n in ("a.csv", "b.tsv.gz", "c.parquet", "d.json", "e.json", "f.json")]
    back = checked.read_by_extension(spark, paths, _PART)
    return base.rounded(back.groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"), F.sum("p_retailprice").alias("retail"), F.min("p_partkey").alias("first_key")), 2)


FORMATS = "SELECT p_type, count(*) AS n, count(DISTINCT p_partkey) AS parts, round(sum(p_retailprice), 2) AS retail, min(p_partkey) AS first_key FROM part GROUP BY p_type"


def series_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' yearly orders as nested API payloads of area series, with monthly rows among them, back to one row for each area and year."""
    o = base.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    c = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    facts = o.join(c, "o_custkey").groupBy("c_nationkey", "o_custkey", "year").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), v.cast("double").alias("v")) for m, v in (("03", 100.0 * F.col("f") / F.col("n")), ("04", F.col("f")), ("06", F.col("n")))]))
    rows = facts.select("c_nationkey", "o_custkey", "year", measures.alias("x")).select("c_nationkey", "o_custkey", "year", "x.*")
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    series = rows.withColumn("seriesID", F.concat(F.lit("LAUCN"), code, F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.col("m")))
    entry = lambda period, v: F.struct(F.col("year").cast("string").alias("year"), F.lit(period).alias("period"), v.cast("string").alias("value"))
    data = series.groupBy("seriesID", (F.col("o_custkey") % 64).alias("part")).agg(F.flatten(F.collect_list(F.array(entry("M13", F.col("v")), entry("M01", F.lit(-1.0))))).alias("data"))
    payloads = data.groupBy("part").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("seriesID", "data")).alias("series")).alias("Results"))).alias("payload"))
    back = checked.series_measures(payloads, "payload")
    return base.rounded(back.groupBy("geography", "state", "year").agg(F.count("*").alias("areas"), F.sum("unemployed").alias("unemployed"), F.sum("labour_force").alias("labour_force"), F.max("unemployment_rate").alias("most"), F.count("employed").alias("employed_known")), 4)


# areas are told apart by the first five digits; of several customers in one the first series counts
SERIES = """WITH f AS (SELECT c_nationkey, o_custkey, CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
a AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS state, o_custkey % 1000 AS area, year, arg_min(f, o_custkey) AS f, arg_min(n, o_custkey) AS n FROM f GROUP BY ALL)
SELECT 'county' AS geography, state, year, count(*) AS areas, CAST(sum(f) AS DOUBLE) AS unemployed, CAST(sum(n) AS DOUBLE) AS labour_force, round(max(f / n), 4) AS most, 0::BIGINT AS employed_known FROM a GROUP BY state, year"""


def mode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of every user and kind that a real run needs, against the mode of their last build: those that would be refused, by reason."""
    e = base.table(spark, sf_dir, "events")
    key = F.concat_ws("-", "event_type", "user_id")
    mode = F.when(F.col("event_id") % 3 == 0, "real").when(F.col("event_id") % 3 == 1, "sample")
    provenance = tables.latest_records(e.select(key.alias("artifact"), "event_id", mode.alias("mode")), ["artifact"], [F.desc("event_id")])
    users = e.select("user_id").distinct()
    kinds = e.select("event_type").distinct()
    required = users.crossJoin(F.broadcast(kinds)).select(key.alias("artifact"), F.concat(F.lit("pull-"), "event_type").alias("command"))
    return gates.refusals(required, provenance, "artifact").groupBy("command", "reason").agg(F.count("*").alias("n"), F.min("artifact").alias("first_artifact"))


MODE_GATE = """WITH p AS (SELECT event_type || '-' || user_id AS artifact, max(event_id) AS e FROM events GROUP BY ALL),
r AS (SELECT t.event_type || '-' || u.user_id AS artifact, 'pull-' || t.event_type AS command FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t),
x AS (SELECT r.*, CASE WHEN p.artifact IS NULL THEN 'missing' WHEN e % 3 = 2 THEN 'unlabelled' WHEN e % 3 = 1 THEN 'sample' END AS reason FROM r LEFT JOIN p ON p.artifact = r.artifact)
SELECT command, reason, count(*) AS n, min(artifact) AS first_artifact FROM x WHERE reason IS NOT NULL GROUP BY ALL"""


_CONTROLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_NAMES = ["urgent", "high", "medium", "unspecified", "low"]


def dated_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as policies of a nation with a begin and an end (some open, some missing, some backwards), for everybody or a group: the policy of each control in force in every year."""
    o = base.table(spark, sf_dir, "orders").join(base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    start = F.year("o_orderdate")
    end = F.when(F.col("o_orderkey") % 5 == 0, 2999).when(F.col("o_orderkey") % 5 == 1, F.lit(None)).when(F.col("o_orderkey") % 5 == 2, start - 1).otherwise(start + F.col("o_orderkey") % 4)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in zip(_CONTROLS, _NAMES) for x in pair]), F.col("o_orderpriority"))
    scope = F.when(F.col("c_mktsegment") == "BUILDING", "All").when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    rows = o.select("c_nationkey", "o_orderkey", start.alias("start"), end.cast("int").alias("end"), F.lit(2001).alias("sheet"), name.alias("control"), scope.alias("family_group"), "o_totalprice")
    out = policies.policy_years(rows, ["c_nationkey"], "control", "o_totalprice", _NAMES, "start", "end", "sheet", ["family_group"], "o_orderkey", 1994, 2001)
    return base.rounded(out, 2)


DATED = f"""WITH o AS (SELECT c_nationkey, o_orderkey, CAST(year(o_orderdate) AS INT) AS s, o_orderpriority AS c, coalesce(c_mktsegment, '') IN ('BUILDING', 'MACHINERY') AS g, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey),
e AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 2001 WHEN 1 THEN 2001 WHEN 2 THEN s - 1 ELSE s + o_orderkey % 4 END AS e FROM o),
y AS (SELECT *, unnest(range(s, CASE WHEN e < s OR e - s > 30 THEN s ELSE e END + 1)) AS year FROM e),
r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY g DESC, s DESC, o_orderkey DESC) AS k FROM y WHERE year BETWEEN 1994 AND 2001 WINDOW w AS (PARTITION BY c_nationkey, year, c))
SELECT c_nationkey, CAST(year AS INT) AS year, {", ".join(f"round(max(v) FILTER (c = '{c}'), 2) AS {n}" for c, n in zip(_CONTROLS, _NAMES))}, count(DISTINCT c) AS n_controls, count(*) FILTER (n > 1) AS n_overlaps, count(*) FILTER (g) AS n_general
FROM r WHERE k = 1 GROUP BY c_nationkey, year"""


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand and supply at 60 prices around the base price of every state-year, and the points solved at three alphas."""
    rows = models.scenario_inputs(spark, sf_dir)
    grid = scenario.grid(spark, alpha=(0.0, 0.5, 1.0))
    prices = rows.crossJoin(F.broadcast(grid)).withColumn("price", scenario.solved()["price"])
    wide = prices.groupBy("geo1", "year").agg(*[F.max(F.when(F.col("alpha") == a, F.col("price"))).alias(c) for a, c in ((0.0, "p0"), (0.5, "p50"), (1.0, "p100"))])
    out = scenario.curve_points(rows.join(wide, ["geo1", "year"]), ["geo1", "year"], [(0.5, "p50"), (0.0, "p0"), (1.0, "p100")])
    return base.rounded(out, 4)


CURVES = f"""WITH {models.SCENARIO}, b AS (SELECT *, p0 * (1 + 0.5 * u / q) ** (1 / (ed + es)) AS p50, p0 * (1 + u / q) ** (1 / (ed + es)) AS p100 FROM sc),
g AS (SELECT *, unnest(range(60)) AS place FROM b), c AS (SELECT *, p0 * 0.92 + place * (greatest(p50, p0) * 1.08 - p0 * 0.92) / 59 AS price FROM g)
SELECT geo1, year, 'demand' AS kind, CAST(place AS INT) AS place, CAST(NULL AS DOUBLE) AS alpha, round(price, 4) AS price, round(q * (price / p0) ** (-ed), 4) AS quantity FROM c
UNION ALL SELECT geo1, year, 'supply', CAST(place AS INT), NULL, round(price, 4), round(q * (price / p0) ** es, 4) FROM c
UNION ALL SELECT geo1, year, 'alpha', CAST(place AS INT), alpha, round(price, 4), round(q * (price / p0) ** es, 4) FROM (SELECT *, unnest([0, 1, 2]) AS place, unnest([0.5, 0.0, 1.0])::DOUBLE AS alpha, unnest([p50, p0, p100]) AS price FROM b)"""


def local_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at alpha 0, 0.5 and 1 of the median state-year of those with a rule shock, under the size of the local Wald elasticity of the supply IV."""
    # both panels are computed once, not once for each use
    county, shocks = tables.staged(base.county(spark, sf_dir)), tables.staged(models.shocks(spark, sf_dir))
    iv = tables.staged(identification.supply_iv(spark, sf_dir, county, shocks).select(F.abs("wald_provider").alias("supply_elasticity")))
    treated = shocks.filter(F.abs("shock") > 0).select("geo1").distinct()
    rows = models.scenario_inputs(spark, sf_dir, county).drop("supply_elasticity")
    return base.rounded(scenario.local_scenario(rows, treated, iv, "geo1"), 2)


LOCAL = f"""WITH RECURSIVE {identification.SUPPLY_IV_CTES}, st2 AS ({f"SELECT geo1, year, {base.a2('price', 'population')} AS price, {base.a2('imputed_share', 'population')} AS imputed_share, sum(population) AS population FROM county GROUP BY geo1, year"}),
el AS (SELECT abs(round(max(beta) FILTER (outcome = 'provider') / max(beta) FILTER (outcome = 'price'), 4)) AS es FROM r),
own AS (SELECT geo1, year, price AS p0, population AS q, population * imputed_share AS u FROM st2 WHERE price > 0 AND population > 0 AND population * imputed_share >= 0 AND geo1 IN (SELECT geo1 FROM shocks WHERE abs(shock) > 0)),
m AS (SELECT median(p0) AS p0, median(q) AS q, median(u) AS u, 0.4 AS ed, count(*) AS n_rows, count(DISTINCT geo1) AS n_places FROM own),
p AS (SELECT *, p0 * (1 + alpha * u / q) ** (1 / (ed + es)) AS price FROM (SELECT *, unnest([0.0, 0.5, 1.0])::DOUBLE AS alpha FROM m, el))
SELECT round(p0, 2) AS base_price, round(q, 2) AS market, round(u, 2) AS unpaid, 0.4::DOUBLE AS demand_elasticity, n_rows, n_places, round(es, 2) AS supply_elasticity, alpha, 'solved' AS status, round(price, 2) AS price, round(q * (price / p0) ** es, 2) AS quantity FROM p"""


_STATUS = ["explicit_sheet", "inferred_complement", "proxy_share", "missing"]


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support tables of the release: orders as observations of a component with a support status, events as policy controls."""
    o = base.table(spark, sf_dir, "orders").join(base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("place")), "o_custkey")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(F.col("o_orderpriority").alias("component"), "place", status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("fallback"))
    e = base.table(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    controls = e.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])
    return release.support_tables(rows, controls, kinds)


def release_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support quality, support mix with eligibility, and policy coverage in one schema."""
    return _support(spark, sf_dir)


_SUPPORT_SQL = """o AS (SELECT o_orderpriority AS component, ['explicit_sheet', 'inferred_complement', 'proxy_share', 'missing'][o_orderkey % 4 + 1] AS status, ['explicit', 'inferred', 'proxy', 'missing'][o_orderkey % 4 + 1] AS tier, o_orderkey % 4 < 2 AND o_orderkey % 3 <> 0 AS ok FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT event_type AS component, count(DISTINCT user_id) AS known, (SELECT count(DISTINCT user_id) FROM events) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
support AS (SELECT 'support_quality_summary' AS table_name, component, tier AS label, count(*) AS rows, count(*) AS eligible FROM o GROUP BY ALL
  UNION ALL SELECT 'support_mix_summary', tier, status, count(*), count(*) FILTER (ok) FROM o GROUP BY ALL
  UNION ALL SELECT 'policy_coverage_summary', component, CASE WHEN known >= 0.75 * n THEN 'promoted' ELSE 'sparse' END, n, known FROM k)"""
RELEASE_SUPPORT = f"WITH {_SUPPORT_SQL} SELECT * FROM support"

#: Artifact, group, kind, tier of the release; the last is listed but not built here.
_MANIFEST = [("policy_coverage_summary", "policy", "csv", "appendix"), ("support_mix_summary", "support", "csv", "main"), ("support_quality_summary", "support", "csv", "main"), ("treatment_timing", "rules", "csv", "appendix")]


def release_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support tables written as artifacts, and the bundle's index with existence, bytes and SHA-256 of what was written."""
    support = tables.staged(_support(spark, sf_dir))
    order = ["component", "label"]
    names = [n for n, *_ in _MANIFEST[:3]]
    artifacts = {n: (support.filter(F.col("table_name") == n).select(*order, "rows", "eligible"), order) for n in names}
    manifest = spark.createDataFrame(_MANIFEST, "artifact string, group string, kind string, tier string")
    return release.write_bundle(spark, artifacts, manifest, _folder(spark))


RELEASE_BUNDLE = f"""WITH {_SUPPORT_SQL}, t AS (SELECT table_name AS artifact, 'component,label,rows,eligible' || chr(10) || string_agg(component || ',' || label || ',' || rows || ',' || eligible || chr(10), '' ORDER BY component, label) AS body FROM support GROUP BY table_name),
m AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _MANIFEST)}) v(artifact, "group", kind, tier))
SELECT m.artifact, m."group", m.kind, m.tier, CASE WHEN body IS NULL THEN 0 ELSE 1 END::BIGINT AS n_files, coalesce(octet_length(encode(body)), 0)::BIGINT AS n_bytes, coalesce(sha256(body), '') AS sha256, body IS NOT NULL AS file_exists FROM m LEFT JOIN t USING (artifact)"""

REGISTERED = {
    "year_partitions": (year_partitions, YEAR_PARTITIONS), "text_tables": (text_tables, TEXT_TABLES), "formats_by_extension": (formats_by_extension, FORMATS), "series_payload": (series_payload, SERIES),
    "mode_gate": (mode_gate, MODE_GATE), "dated_policies": (dated_policies, DATED), "curve_points": (curve_points, CURVES), "local_scenario": (local_scenario, LOCAL),
    "release_support": (release_support, RELEASE_SUPPORT), "release_bundle": (release_bundle, RELEASE_BUNDLE),
}
