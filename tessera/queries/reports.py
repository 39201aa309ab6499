"""Report tables over channels and support, release tables, and the normalisers of files (G, C, L, R, N, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import account, eav, lookups, reporting, scenario, segments
from tessera.sources import tables

from . import base, chains, models

KEYS = ["geo1", "year"]
PAID = ["private_unsubsidised", "private_subsidised"]
_QUOTED = ", ".join(f"'{c}'" for c in PAID)


def _scenarios(spark: SparkSession, sf_dir: str, stack: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    parts, _, s = stack or chains._stack(spark, sf_dir)
    wide = segments.channel_wide(parts, KEYS)
    s = s.select(*KEYS, F.col("price").alias("base_price"), (F.col("population") * F.col("imputed_share")).alias("unpaid"), F.lit(0.4).alias("demand_elasticity"), F.lit(1.5).alias("supply_elasticity"))
    return segments.channel_scenarios(segments.channel_inputs(wide, s, KEYS), scenario.grid(spark, alpha=scenario.ALPHAS))


SCENARIOS = f"""{chains.STACK}, ch AS (SELECT unnest(['private_unsubsidised', 'private_subsidised', 'public']) AS channel),
cq AS (SELECT s.geo1, s.year, channel, price AS p0, population * imputed_share AS un, coalesce((SELECT sum(quantity) FROM parts p WHERE p.geo1 = s.geo1 AND p.year = s.year AND p.component = channel), 0) AS q FROM state s, ch WHERE (s.geo1, s.year) IN (SELECT (geo1, year) FROM parts)),
cu AS (SELECT *, CASE WHEN channel = 'public' THEN 0 ELSE coalesce(un * q / nullif(sum(CASE WHEN channel <> 'public' THEN q END) OVER (PARTITION BY geo1, year), 0), 0) END AS u FROM cq),
ca2 AS (SELECT *, unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS alpha FROM cu), cp AS (SELECT *, CASE WHEN channel <> 'public' AND q > 0 THEN p0 * (1 + alpha * u / q) ** (1 / 1.9) ELSE p0 END AS p FROM ca2),
cs AS (SELECT *, q * (p / p0) ** 1.5 AS qs FROM cp)"""

FAMILIES = {"private_unsubsidised": ("private_market", 0.4, 1.5), "private_subsidised": ("private_market", 0.3, 1.5), "public": ("fixed_public", 0.0, 0.0)}


def elasticity_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel's elasticity family, with the channel's quantity over all places."""
    parts, _, _ = chains._stack(spark, sf_dir)
    total = parts.groupBy(F.col("component").alias("channel")).agg(F.sum("quantity").alias("quantity"))
    return base.rounded(total.join(F.broadcast(reporting.elasticity_map(spark, FAMILIES)), "channel"), 4)


FAMILY_SQL = f"""WITH {chains.STACK}, m AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{f}', {d}, {s})" for c, (f, d, s) in FAMILIES.items())}) t(channel, family, demand_elasticity, supply_elasticity))
SELECT channel, round(sum(quantity), 4) AS quantity, any_value(family) AS family, any_value(demand_elasticity)::DOUBLE AS demand_elasticity, any_value(supply_elasticity)::DOUBLE AS supply_elasticity FROM parts JOIN m ON channel = component GROUP BY channel"""


def segment_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced private segments (age by provider) of each state and year; all states and years of the panel are kept."""
    m = base.micro(spark, sf_dir)
    priced = m.filter("channel = 'P' and price > 0").withColumn("segment", F.concat_ws("/", "age", "provider"))
    return reporting.segment_support(priced, m, KEYS, "segment", 8)


SEGMENT_SUPPORT = f"""WITH {base.MICRO}, n AS (SELECT geo1, year, count(DISTINCT age || '/' || provider) AS n FROM micro WHERE channel = 'P' AND price > 0 GROUP BY ALL), p AS (SELECT DISTINCT geo1, year FROM micro)
SELECT p.geo1, p.year, coalesce(n, 0) AS n_segments, CASE WHEN n >= 8 THEN 'supported' WHEN n > 0 THEN 'thin' ELSE 'missing' END AS status FROM p LEFT JOIN n ON n.geo1 = p.geo1 AND n.year = p.year"""


def channel_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel's response over the alphas."""
    return base.rounded(reporting.channel_response(_scenarios(spark, sf_dir)), 4)


RESPONSE = f"""WITH {SCENARIOS}, r AS (SELECT channel, alpha, sum(q) AS base_quantity, sum(qs) AS quantity, bool_and(abs(p - p0) < 1e-9) AS price_invariant, count(*) AS n FROM cs GROUP BY ALL)
SELECT channel, alpha, round(base_quantity, 4) AS base_quantity, round(quantity, 4) AS quantity, price_invariant, n, round(quantity - base_quantity, 4) AS delta, round((quantity - base_quantity) / nullif(base_quantity, 0), 4) AS change FROM r"""


def _support(spark: SparkSession, sf_dir: str, state: DataFrame | None = None) -> DataFrame:
    s = tables.staged(base.state(spark, sf_dir)) if state is None else state
    program = s.select(*KEYS, F.when(F.col("geo1") % 3 != 0, F.col("population") * 0.05).alias("program_slots"))
    admin = s.select(*KEYS, F.when(F.col("geo1") % 2 == 0, F.col("population") * F.col("imputed_share") * 2).alias("admin_slots"))
    return segments.public_slots(program, admin, s.select(*KEYS, "population"), KEYS).withColumn("tier", S.support_tier("slot_status"))


SUPPORT = f"""{base.STATE}, su0 AS (SELECT geo1, year, population, CASE WHEN geo1 % 3 <> 0 THEN population * 0.05 END AS a, CASE WHEN geo1 % 2 = 0 THEN population * imputed_share * 2 END AS b FROM state),
su AS (SELECT geo1, year, coalesce(a, 0) + coalesce(b, 0) AS public_slots, (coalesce(a, 0) + coalesce(b, 0)) / population AS slot_share, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'explicit_both' WHEN a IS NOT NULL THEN 'explicit_program' WHEN b IS NOT NULL THEN 'explicit_admin' ELSE 'missing' END || CASE WHEN (coalesce(a, 0) + coalesce(b, 0)) / population > 0.5 THEN '_downgraded' ELSE '' END AS slot_status,
  CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN (coalesce(a, 0) + coalesce(b, 0)) / population > 0.5 THEN 'proxy' ELSE 'explicit' END AS tier FROM su0)"""


def support_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support labels of every state's slots by tier, its share of all slots and its main issue; no state is left out."""
    out = _support(spark, sf_dir).groupBy("geo1").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("explicit", "proxy", "missing")], F.sum("public_slots").alias("slots"))
    issue = F.when(F.col("missing") > 0, "missing_slots").when(F.col("proxy") > 0, "large_gap").otherwise("none")
    return base.rounded(out.withColumns({"issue": issue, "slot_share": F.col("slots") / F.sum("slots").over(Window.partitionBy(F.lit(1)))}))


BY_STATE = f"""WITH {SUPPORT}, g AS (SELECT geo1, count(*) FILTER (tier = 'explicit') AS explicit, count(*) FILTER (tier = 'proxy') AS proxy, count(*) FILTER (tier = 'missing') AS missing, sum(public_slots) AS slots FROM su GROUP BY geo1)
SELECT geo1, explicit, proxy, missing, round(slots, 6) AS slots, CASE WHEN missing > 0 THEN 'missing_slots' WHEN proxy > 0 THEN 'large_gap' ELSE 'none' END AS issue, round(slots / sum(slots) OVER (), 6) AS slot_share FROM g"""


def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary row nearest the headline alpha of each state and year, with support metadata and typed defaults."""
    stack = chains._stack(spark, sf_dir)
    rows = segments.scenario_summary(_scenarios(spark, sf_dir, stack), KEYS)
    near = segments.nearest_alpha(rows, KEYS)
    known = _support(spark, sf_dir, stack[2]).filter("tier <> 'missing'").select(*KEYS, "slot_status", "public_slots", F.lit(True).alias("has_support"))
    out = reporting.with_defaults(near, known, KEYS, {"slot_status": "missing", "public_slots": 0.0, "has_support": False})
    return base.rounded(out.select(*KEYS, "alpha", "private_price", "private_quantity", "slot_status", "public_slots", "has_support"), 3)


FALLBACK = f"""WITH {SCENARIOS}, su_ AS (WITH {SUPPORT} SELECT * FROM su WHERE tier <> 'missing'), r AS (SELECT geo1, year, alpha, sum(qs) FILTER (channel <> 'public') AS pq_, coalesce(sum(p * qs) FILTER (channel <> 'public') / nullif(sum(qs) FILTER (channel <> 'public'), 0), 0) AS pp FROM cs WHERE alpha = 0.5 GROUP BY ALL)
SELECT r.geo1, r.year, alpha, round(pp, 3) AS private_price, round(pq_, 3) AS private_quantity, coalesce(slot_status, 'missing') AS slot_status, round(coalesce(public_slots, 0), 3) AS public_slots, slot_status IS NOT NULL AS has_support FROM r LEFT JOIN su_ ON su_.geo1 = r.geo1 AND su_.year = r.year"""


def channel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel quantities by state and year with their share of the paid total."""
    parts, _, _ = chains._stack(spark, sf_dir)
    rows = parts.groupBy(*KEYS, F.col("component").alias("channel")).agg(F.sum("quantity").alias("quantity"), F.bool_or("fallback").alias("fallback"))
    return base.rounded(reporting.channel_shares(rows, KEYS, PAID), 6)


CHANNEL_TABLE = f"""WITH {chains.STACK}, c AS (SELECT geo1, year, component AS channel, sum(quantity) AS quantity, bool_or(fallback) AS fallback FROM parts GROUP BY ALL)
SELECT geo1, year, channel, round(quantity, 6) AS quantity, fallback, round(CASE WHEN channel IN ({_QUOTED}) THEN quantity / nullif(sum(CASE WHEN channel IN ({_QUOTED}) THEN quantity ELSE 0 END) OVER (PARTITION BY geo1, year), 0) END, 6) AS paid_share FROM c"""


def policy_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's policy controls beside its quantities; controls that are not known get the default 0."""
    parts, _, _ = chains._stack(spark, sf_dir)
    total = parts.groupBy(*KEYS).agg(F.sum("quantity").alias("quantity"))
    policy = chains.policy_wide_rows(spark, sf_dir).withColumnRenamed("geo", "geo1")
    out = reporting.with_defaults(total, policy, ["geo1"], {c: 0.0 for c in chains.CONTROLS} | {"n_controls": 0})
    return base.rounded(out, 4)


POLICY_QUANTITIES = f"""WITH {chains.STACK}, {chains.POLICY_CTE}, t AS (SELECT geo1, year, sum(quantity) AS quantity FROM parts GROUP BY ALL)
SELECT geo1, year, round(quantity, 4) AS quantity, {", ".join(f"round(coalesce({c}, 0), 4) AS {c}" for c in chains.CONTROLS)}, coalesce(n_controls, 0) AS n_controls FROM t LEFT JOIN w ON geo = geo1"""


def publication_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel table at the headline alpha, channels in their order."""
    rows = _scenarios(spark, sf_dir).filter("alpha = 0.5")
    place = F.array_position(F.array(*[F.lit(c) for c in segments.CHANNELS]), F.col("channel"))
    change = F.try_divide(F.col("price") - F.col("base_price"), F.col("base_price"))
    return base.rounded(rows.select(*KEYS, "channel", place.alias("position"), "base_price", "price", "quantity", change.alias("price_change")), 4)


PUBLICATION_CHANNELS = f"""WITH {SCENARIOS} SELECT geo1, year, channel, list_position([{", ".join(f"'{c}'" for c in segments.CHANNELS)}], channel)::BIGINT AS position, round(p0, 4) AS base_price, round(p, 4) AS price, round(qs, 4) AS quantity, round((p - p0) / p0, 4) AS price_change FROM cs WHERE alpha = 0.5"""


def publication_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support rows with their tier, ranked by tier and then by the smallest slots."""
    rows = _support(spark, sf_dir).withColumn("tier_rank", reporting.tier_rank(F.col("tier")))
    rank = F.row_number().over(Window.partitionBy("year").orderBy("tier_rank", "public_slots", "geo1"))
    return base.rounded(rows.select(*KEYS, "slot_status", "tier", "tier_rank", "public_slots", rank.alias("rank")))


PUBLICATION_FALLBACKS = f"""WITH {SUPPORT}, r AS (SELECT *, list_position(['explicit', 'inferred', 'proxy', 'missing'], tier)::BIGINT AS tier_rank FROM su)
SELECT geo1, year, slot_status, tier, tier_rank, round(public_slots, 6) AS public_slots, CAST(row_number() OVER (PARTITION BY year ORDER BY tier_rank, public_slots, geo1) AS INT) AS rank FROM r"""


def support_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, share and fallback rows of each tier, the tier read from the status text."""
    rows = _support(spark, sf_dir).withColumns({"tier": reporting.keyword_tier(F.col("slot_status")), "fallback": F.col("slot_status").contains("downgraded")})
    return base.rounded(reporting.quality_by_tier(rows, "tier", "fallback"))


QUALITY = f"""WITH {SUPPORT}, k AS (SELECT CASE WHEN contains(slot_status, 'explicit') THEN 'explicit' ELSE 'missing' END AS tier, contains(slot_status, 'downgraded') AS f FROM su)
SELECT tier, count(*) AS n, count(*) FILTER (f) AS n_fallback, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY tier"""


def issue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and states of each main issue."""
    rows = _support(spark, sf_dir)
    label = reporting.issue_label(F.col("tier"), F.col("slot_status") == "explicit_admin", F.col("slot_share"), 0.6)
    return reporting.issue_breakdown(rows.withColumn("issue", label), "issue", "geo1")


ISSUES = f"""WITH {SUPPORT}, i AS (SELECT geo1, CASE WHEN tier = 'missing' THEN 'missing_support' WHEN slot_share > 0.6 THEN 'large_gap' WHEN tier = 'proxy' THEN 'proxy_support' WHEN slot_status = 'explicit_admin' THEN 'fallback' ELSE 'none' END AS issue FROM su)
SELECT issue, count(*) AS n_rows, count(DISTINCT geo1) AS n_places FROM i GROUP BY issue"""

WANTED = ["blue", "green", "red", "ring", "widget"]


def sheet_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as files, the words of part names as what they hold: wanted words matched and missing."""
    words = base.table(spark, sf_dir, "part").select("p_type", F.explode(F.split(F.lower("p_name"), r"\s+")).alias("word")).distinct()
    return reporting.focus_targets(words, "p_type", "word", WANTED)


_WANT = "[" + ", ".join(f"'{w}'" for w in WANTED) + "]"
SHEET_TARGETS = rf"""WITH w AS (SELECT p_type, list(DISTINCT word) AS own FROM (SELECT p_type, unnest(string_split_regex(lower(p_name), '\s+')) AS word FROM part) GROUP BY p_type)
SELECT p_type, array_to_string(list_filter({_WANT}, lambda x: list_contains(own, x)), '|') AS matched, array_to_string(list_filter({_WANT}, lambda x: NOT list_contains(own, x)), '|') AS missing, CAST(len(list_filter({_WANT}, lambda x: NOT list_contains(own, x))) AS INT) AS n_missing FROM w"""


def parse_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind as files: raw rows, rows whose value counts as parsed (one or more), and a status."""
    events = base.table(spark, sf_dir, "events")
    return reporting.parse_inventory(events, ["event_type"], F.col("value") >= 1)


PARSE = """SELECT event_type, count(*) AS raw_rows, count(*) FILTER (value >= 1) AS parsed_rows, CASE WHEN count(*) FILTER (value >= 1) = 0 THEN 'empty' WHEN count(*) FILTER (value >= 1) < count(*) THEN 'partial' ELSE 'parsed' END AS status FROM events GROUP BY event_type"""


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By nation: customers of two groups as the two sexes, one-parent share and employment rate; nations without are null."""
    c = base.table(spark, sf_dir, "customer")
    count = lambda *kinds: F.count_if(F.col("c_mktsegment").isin(*kinds)).cast("double")
    rows = c.groupBy("c_nationkey").agg(count("BUILDING").alias("male"), count("MACHINERY").alias("female"), count("FURNITURE").alias("one_parent"), *[count(k).alias(n) for n, k in (("e1", "AUTOMOBILE"), ("e2", "HOUSEHOLD"))])
    return base.rounded(reporting.demographics(rows, "male", "female", "one_parent", ["e1", "e2"]).select("c_nationkey", "children", "one_parent_share", "employment_rate"))


DEMOGRAPHICS = """WITH s AS (SELECT c_nationkey, CAST(count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS DOUBLE) AS children, count(*) FILTER (c_mktsegment = 'FURNITURE') AS o, count(*) FILTER (c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')) AS e FROM customer GROUP BY ALL)
SELECT c_nationkey, children, round(o / nullif(children, 0), 6) AS one_parent_share, round(e / nullif(children, 0), 6) AS employment_rate FROM s"""


def birth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by customer code as a births file has them: codes checked, thousands' marks and asterisks dropped, suppressed rows told apart."""
    o = base.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    text = F.when(F.col("o_custkey") % 7 == 0, "Suppressed").when(F.col("o_custkey") % 5 == 0, F.concat(F.format_number("total", 0), F.lit("*"))).otherwise(F.format_number("total", 0))
    code = F.when(F.col("o_custkey") % 11 == 0, F.lit("total")).otherwise(F.lpad(F.col("o_custkey").cast("string"), 5, "0"))
    return reporting.births(o.select(code.alias("code"), text.alias("text")), "code", "text").select("code", "births", "suppressed")


BIRTHS = """WITH o AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY ALL) SELECT lpad(k::VARCHAR, 5, '0') AS code, CASE WHEN k % 7 <> 0 THEN round_even(t, 0) END AS births, k % 7 = 0 AS suppressed FROM o WHERE k % 11 <> 0"""


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows from four possible value columns, the last row of each (nation, year, status, priority) kept."""
    o = base.table(spark, sf_dir, "orders").join(base.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k, price = F.col("o_orderkey"), F.round("o_totalprice", 2).cast("string")
    cols = {f"v{i}": F.when(k % 4 == i, price).otherwise(F.lit("n/a") if i == 1 else None) for i in range(4)}
    rows = o.select("o_orderkey", "c_nationkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority").join(o.select("o_orderkey", *[c.alias(n) for n, c in cols.items()]), "o_orderkey")
    keys = ["c_nationkey", "year", "o_orderstatus", "o_orderpriority"]
    return base.rounded(reporting.rule_level(rows, list(cols), keys, "o_orderkey").select(*keys, "value"), 2)


RULE_ROWS = """SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus, o_orderpriority, round(arg_max(o_totalprice, o_orderkey), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def wide_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rule columns as numbers, one row for each state and year (the first by part)."""
    m = base.micro(spark, sf_dir).select("geo1", "year", "partkey", "orderkey", "line")
    p = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_size").cast("string").alias("size"), F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.col("p_retailprice").cast("string")).alias("retail"))
    rows = m.join(p, "partkey").withColumn("order_", F.struct("partkey", "orderkey", "line"))
    return base.rounded(reporting.wide_rules(rows, KEYS, ["size", "retail"], "order_"), 2)


WIDE_RULES = f"""WITH {base.MICRO}, r AS (SELECT geo1, year, p_size, p_partkey, p_retailprice, row_number() OVER (PARTITION BY geo1, year ORDER BY partkey, orderkey, line) AS n FROM micro JOIN part ON p_partkey = partkey)
SELECT geo1, year, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 3 <> 0 THEN round(p_retailprice, 2) END AS retail FROM r WHERE n = 1"""


def places_and_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation and a year out of the first candidate column that has one."""
    n = base.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = base.table(spark, sf_dir, "orders").join(base.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    names = n.select(F.col("n_name").alias("name"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"))
    rows = o.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.when(F.col("o_orderkey") % 3 == 0, F.col("n_name"))
    second = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    sheet = F.concat(F.lit("FY20"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"))
    found = reporting.with_place_and_year(rows, [first, second], [F.when(F.col("o_orderkey") % 2 == 0, sheet), F.lit("as of 2031")], names)
    return found.groupBy("place", "found_year").agg(F.count("*").alias("n"))


PLACES = """SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS place, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2000 + o_orderkey % 30 ELSE 2031 END AS INT) AS found_year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: every feature seen, with its rows, places, first and last value in order."""
    e = base.table(spark, sf_dir, "events").withColumn("place", F.col("user_id") % 25)
    out = e.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_distinct("place").alias("n_places"), F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))
    return base.rounded(out)


AUDIT = """SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id % 25) AS n_places, round(arg_min(value, event_id), 6) AS first_value, round(arg_max(value, event_id), 6) AS last_value FROM events GROUP BY ALL"""


def proxy_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed weight as a proxy of the returned one by county and year: gaps, their size, and their rank in the state."""
    m = base.micro(spark, sf_dir).groupBy("geo1", "geo2", "year").agg(F.sum(F.when(F.col("observed"), F.col("weight"))).alias("proxy"), F.sum(F.when(F.col("imputed"), F.col("weight"))).alias("known"))
    rows = reporting.proxy_gaps(m, "proxy", "known", 0.5)
    rank = F.row_number().over(Window.partitionBy("geo1").orderBy(F.desc(F.abs("gap")), "geo2", "year"))
    return base.rounded(rows.withColumn("rank", rank))


PROXY_GAPS = f"""WITH {base.MICRO}, m AS (SELECT geo1, geo2, year, sum(weight) FILTER (observed) AS proxy, sum(weight) FILTER (imputed) AS known FROM micro GROUP BY ALL), g AS (SELECT *, proxy - known AS gap, abs(proxy - known) / nullif(abs(known), 0) AS gap_share FROM m WHERE proxy IS NOT NULL AND known IS NOT NULL)
SELECT geo1, geo2, year, round(proxy, 6) AS proxy, round(known, 6) AS known, round(gap, 6) AS gap, round(gap_share, 6) AS gap_share, CASE WHEN gap_share > 0.5 THEN 'large' ELSE 'small' END AS size, CAST(row_number() OVER (PARTITION BY geo1 ORDER BY abs(gap) DESC, geo2, year) AS INT) AS rank FROM g"""


def methods_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assumptions in force beside the counts that they were used on, one row each."""
    s = base.state(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(F.col("price") > 0).alias("priced"))
    table = account.assumption_table(spark, {"demand_elasticity": 0.4, "headline_alpha": 0.5, "large_gap": 0.5, "core_first": float(base.CORE_FIRST), "core_last": float(base.CORE_LAST)})
    return table.crossJoin(F.broadcast(s))


METHODS = f"""WITH {base.STATE}, a AS (SELECT * FROM (VALUES ('demand_elasticity', 0.4), ('headline_alpha', 0.5), ('large_gap', 0.5), ('core_first', {base.CORE_FIRST}), ('core_last', {base.CORE_LAST})) t(name, value))
SELECT name, value::DOUBLE AS value, (SELECT count(*) FROM state) AS rows, (SELECT count(*) FROM state WHERE price > 0) AS priced FROM a"""


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey spending by market segment beside the panel's own prices by year, and their ratio."""
    m = base.micro(spark, sf_dir)
    survey = m.groupBy("year", "age").agg(F.avg("amount").alias("mean_spend"), F.avg((F.col("channel") == "F").cast("double")).alias("paid_share"))
    own = base.state(spark, sf_dir).groupBy("year").agg(F.avg("price").alias("panel_price"))
    return base.rounded(survey.join(F.broadcast(own), "year", "left").withColumn("ratio", F.col("mean_spend") / F.col("panel_price")), 4)


VALIDATION = f"""WITH {base.STATE}, v AS (SELECT year, age, avg(amount) AS mean_spend, avg(CAST(channel = 'F' AS DOUBLE)) AS paid_share FROM micro GROUP BY ALL), o AS (SELECT year, avg(price) AS panel_price FROM state GROUP BY year)
SELECT v.year, age, round(mean_spend, 4) AS mean_spend, round(paid_share, 4) AS paid_share, round(panel_price, 4) AS panel_price, round(mean_spend / panel_price, 4) AS ratio FROM v LEFT JOIN o ON o.year = v.year"""


def instrument_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each source label of the price, and the share that is not observed, by year."""
    m = base.micro(spark, sf_dir).withColumn("label", F.when(F.col("observed") & F.col("imputed"), "observed_imputed").when(F.col("observed"), "observed").when(F.col("imputed"), "imputed_model").otherwise("nowcast"))
    out = m.groupBy("year", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("year")
    share = F.col("n") / F.sum("n").over(w)
    imputed = 1 - F.sum(F.when(F.col("label").contains("observed"), F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return base.rounded(out.withColumns({"share": share, "imputed_share": imputed}))


INSTRUMENTS = f"""WITH {base.MICRO}, l AS (SELECT year, CASE WHEN observed AND imputed THEN 'observed_imputed' WHEN observed THEN 'observed' WHEN imputed THEN 'imputed_model' ELSE 'nowcast' END AS label, count(*) AS n FROM micro GROUP BY ALL)
SELECT year, label, n, round(n / sum(n) OVER w, 6) AS share, round(1 - sum(CASE WHEN contains(label, 'observed') THEN n ELSE 0 END) OVER w / sum(n) OVER w, 6) AS imputed_share FROM l WINDOW w AS (PARTITION BY year)"""


def labour_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage fits over thresholds of the observed share, and which of the passing fits is the first by strength."""
    rows = models.demand_rows(spark, sf_dir)
    limits = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.4, 0.5, 0.75)])
    rows = rows.withColumn("least_support", F.explode(F.filter(limits, lambda t: F.col("observed_share") >= t)))
    from tessera.operators import moments

    fits = rows.groupBy("least_support").agg(*moments.just_identified("hours", "price", "outside", F.col("rw")))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("n") >= 30), F.desc("first_stage_f"), "least_support"))
    return base.rounded(fits.withColumns({"passes": F.col("n") >= 30, "rank": rank}), 4)


SWEEP = f"""WITH {models.DEMAND}, th AS (SELECT unnest([0.0, 0.25, 0.4, 0.5, 0.75])::DOUBLE AS least_support), r AS (SELECT * FROM dem, th WHERE observed_share >= least_support),
s AS (SELECT least_support, count(*) AS n, sum(rw) AS w, sum(rw * outside) AS z, sum(rw * price) AS p, sum(rw * hours) AS y, sum(rw * outside * price) AS zp, sum(rw * outside * hours) AS zy, sum(rw * outside * outside) AS zz, sum(rw * price * price) AS pp FROM r GROUP BY least_support),
c AS (SELECT least_support, n, p, y, zp - z * p / w AS zp, zy - z * y / w AS zy, zz - z * z / w AS zz, pp - p * p / w AS pp FROM s), f AS (SELECT *, (zp / zz) * (zp / zz) * zz * (n - 2) / (pp - zp / zz * zp) AS ff FROM c)
SELECT least_support, n, round(zp / zz, 4) AS first_stage, round(ff, 4) AS first_stage_f, round(zy / zp, 4) AS price_coefficient, round(zy / zp * p / y, 4) AS elasticity_at_mean, n >= 30 AS passes, CAST(row_number() OVER (ORDER BY n >= 30 DESC, ff DESC, least_support) AS INT) AS rank FROM f"""

REGISTERED = {
    "elasticity_families": (elasticity_families, FAMILY_SQL), "segment_support": (segment_support, SEGMENT_SUPPORT), "channel_response": (channel_response, RESPONSE), "support_by_state": (support_by_state, BY_STATE),
    "fallback_summary": (fallback_summary, FALLBACK), "channel_table": (channel_table, CHANNEL_TABLE), "policy_quantities": (policy_quantities, POLICY_QUANTITIES), "publication_channels": (publication_channels, PUBLICATION_CHANNELS),
    "publication_fallbacks": (publication_fallbacks, PUBLICATION_FALLBACKS), "support_quality": (support_quality, QUALITY), "issue_breakdown": (issue_breakdown, ISSUES), "sheet_targets": (sheet_targets, SHEET_TARGETS),
    "parse_inventory": (parse_inventory, PARSE), "demographics": (demographics, DEMOGRAPHICS), "birth_counts": (birth_counts, BIRTHS), "rule_rows": (rule_rows, RULE_ROWS), "wide_rules": (wide_rules, WIDE_RULES),
    "places_and_years": (places_and_years, PLACES), "feature_audit": (feature_audit, AUDIT), "proxy_gap_rows": (proxy_gap_rows, PROXY_GAPS), "validation": (validation, VALIDATION), "methods_record": (methods_record, METHODS),
    "instrument_audit": (instrument_audit, INSTRUMENTS), "labour_sweep": (labour_sweep, SWEEP),
}
