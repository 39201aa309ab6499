"""Normalisers, segments and channels, EAV mapping, rules and release tables (N, G, C, L and R families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import weighted as W
from tessera.operators import account, eav, lookups, rules, scenario, segments
from tessera.sources import tables

from . import base

# ---- N: normalisers


def time_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to respondents: minutes by activity, any-work flag, weekly hours, days in scope, group births joined back."""
    e = base.table(spark, sf_dir, "events")
    care = F.col("event_type").isin("view", "click")
    r = e.groupBy("user_id").agg(F.sum(F.when(care, F.col("value")).otherwise(0.0)).alias("minutes"), F.max((F.col("event_type") == "purchase").cast("int")).alias("works"), F.count("*").alias("n"))
    r = r.withColumns({"state": F.col("user_id") % 25, "hours": F.col("minutes") / 60 * 7, "year": (2018 + F.col("user_id") % 4).cast("int")})
    leap = (F.col("year") % 4 == 0) & ((F.col("year") % 100 != 0) | (F.col("year") % 400 == 0))
    days = F.when(F.col("year") == 2020, 313).when(leap, 366).otherwise(365)
    r = r.withColumn("weight", F.col("n") / days)
    births = r.groupBy("state", "year").agg((F.count("*") * 12 + F.sum("works") * 250).alias("births"))
    out = r.join(births, ["state", "year"], "left").groupBy("state", "year").agg(F.sum("hours").alias("hours"), F.sum("weight").alias("weight"), W.weighted_mean_or_null("hours", "weight").alias("mean_hours"), F.max("births").alias("births"))
    return base.rounded(out)


TIME_USE = """WITH r AS (SELECT user_id, sum(CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0 END) AS minutes, max(CAST(event_type = 'purchase' AS INT)) AS works, count(*) AS n, user_id % 25 AS state, CAST(2018 + user_id % 4 AS INT) AS year FROM events GROUP BY user_id),
w AS (SELECT *, minutes / 60 * 7 AS hours, n / CASE WHEN year = 2020 THEN 313 WHEN year % 4 = 0 THEN 366 ELSE 365 END AS weight FROM r)
SELECT state, year, round(sum(hours), 6) AS hours, round(sum(weight), 6) AS weight, round(sum(hours * weight) / sum(weight), 6) AS mean_hours, CAST(count(*) * 12 + sum(works) * 250 AS BIGINT) AS births FROM w GROUP BY ALL"""


def price_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(price, flag) column pairs to rows by a spec; yearly price, imputed unless flagged 1, wages per hour."""
    p = base.table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_retailprice") / 52).alias("price_a"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 1.0).alias("price_b"), (F.col("p_size") % 2).alias("flag_a"), (F.col("p_size") % 3).alias("flag_b"))
    pairs = F.array(*[F.struct(F.lit(n).alias("age"), F.col(f"price_{n}").alias("weekly"), F.col(f"flag_{n}").alias("flag")) for n in ("a", "b")])
    long = p.select("p_brand", F.explode(pairs).alias("x")).select("p_brand", "x.*").filter("weekly is not null")
    imputed = F.when(F.col("flag") == 1, 0.0).otherwise(1.0)
    return base.rounded(long.groupBy("p_brand", "age").agg(F.avg(F.col("weekly") * 52).alias("annual_price"), F.avg(imputed).alias("imputed_share"), F.avg(F.col("weekly") / 40).alias("hourly"), F.count("*").alias("n")))


PAIRS = """WITH l AS (SELECT p_brand, 'a' AS age, p_retailprice / 52 AS weekly, p_size % 2 AS flag FROM part UNION ALL SELECT p_brand, 'b', p_size * 1.0, p_size % 3 FROM part WHERE p_size % 4 <> 0)
SELECT p_brand, age, round(avg(weekly * 52), 6) AS annual_price, round(avg(CASE WHEN flag = 1 THEN 0.0 ELSE 1.0 END), 6) AS imputed_share, round(avg(weekly / 40), 6) AS hourly, count(*) AS n FROM l GROUP BY ALL"""


def measure_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures decoded and pivoted per key, only for wanted keys; the latest value of each."""
    o = base.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    wanted = base.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    kept = o.join(wanted, "o_custkey", "left_semi")
    wide = kept.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")))
    return base.rounded(wide.withColumn("rate", F.try_divide(F.col("F"), F.col("O")) / 100), 4)


PIVOT = """WITH k AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
w AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS f, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O') AS o, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'P') AS p FROM k GROUP BY ALL)
SELECT o_custkey, round(f, 4) AS F, round(o, 4) AS O, round(p, 4) AS P, round(f / o / 100, 4) AS rate FROM w"""


def program_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sites matched to places by a cleaned name, slots summed, sites counted, school flags as a share."""
    sites = base.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", (F.col("s_acctbal") / 100).alias("slots"), F.concat(F.lit("Nation_"), F.col("s_nationkey").cast("string"), F.lit(" County")).alias("place"))
    places = base.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", S.county_key("n_name").alias("key"))
    joined = sites.withColumn("key", S.county_key("place")).join(F.broadcast(places), "key")
    return base.rounded(joined.groupBy("n_regionkey").agg(F.sum("slots").alias("slots"), F.count_distinct("s_suppkey").alias("sites"), F.avg((F.col("slots") > 50).cast("double")).alias("large_share")))


SITES = """SELECT n_regionkey, round(sum(s_acctbal / 100), 6) AS slots, count(DISTINCT s_suppkey) AS sites, round(avg(CASE WHEN s_acctbal / 100 > 50 THEN 1.0 ELSE 0.0 END), 6) AS large_share
FROM supplier JOIN nation ON n_name = 'NATION_' || s_nationkey WHERE s_acctbal > 0 GROUP BY ALL"""


def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rates of overlapping subgroups by year."""
    o = base.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_totalprice") > 150000, "large"), F.when(F.col("o_orderpriority").startswith("1"), "urgent")))
    rows = o.withColumn("subgroup", F.explode(labels))
    paid = (F.col("o_orderstatus") == "F").cast("double")
    return base.rounded(rows.groupBy("year", "subgroup").agg(
        F.count("*").alias("records"), W.weighted_mean_or_null(paid, F.col("o_totalprice")).alias("paid_rate"), F.avg("o_totalprice").alias("mean_spend"),
        F.avg(F.when(paid == 1, F.col("o_totalprice"))).alias("mean_spend_payers"), F.try_divide(F.sum(paid * F.col("o_totalprice")), F.sum("o_totalprice")).alias("spend_share"),
    ))


SUBGROUPS = """WITH r AS (SELECT CAST(year(o_orderdate) AS INT) AS year, unnest(list_filter(['all', CASE WHEN o_totalprice > 150000 THEN 'large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS subgroup, o_totalprice AS p, CAST(o_orderstatus = 'F' AS DOUBLE) AS f FROM orders)
SELECT year, subgroup, count(*) AS records, round(sum(p * f) / sum(p), 6) AS paid_rate, round(avg(p), 6) AS mean_spend, round(avg(p) FILTER (f = 1), 6) AS mean_spend_payers, round(sum(f * p) / sum(p), 6) AS spend_share FROM r GROUP BY ALL"""


def storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to place-day loads: counts, damage from suffixed text, distinct days, exposure."""
    e = base.table(spark, sf_dir, "events").withColumn("place", F.col("user_id") % 25)
    text = F.concat(F.col("value").cast("string"), F.when(F.col("event_id") % 2 == 0, "K").otherwise(""))
    bad = F.col("event_type").isin("error", "click")
    out = e.groupBy("place").agg(F.count("*").alias("events"), F.sum(S.magnitude_money(text)).alias("damage"), F.count_distinct(F.when(bad, F.to_date("ts"))).alias("days"))
    top = out.agg(F.max("events").alias("_m"))
    return base.rounded(out.crossJoin(F.broadcast(top)).withColumn("exposure", F.col("events") / F.col("_m")).drop("_m"), 4)


STORMS = """WITH s AS (SELECT user_id % 25 AS place, count(*) AS events, sum(CASE WHEN value < 0 THEN 0 WHEN event_id % 2 = 0 THEN value * 1000 ELSE value END) AS damage, count(DISTINCT CASE WHEN event_type IN ('error', 'click') THEN CAST(ts AS DATE) END) AS days FROM events GROUP BY ALL)
SELECT place, events, round(damage, 4) AS damage, days, round(events / max(events) OVER (), 4) AS exposure FROM s"""


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-level tables: the header row is the first whose first cell is 'state'; columns found by keyword; totals dropped."""
    n = base.table(spark, sf_dir, "orders").join(base.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("sheet"), "c_nationkey").agg(F.count("*").alias("a"), F.sum("o_totalprice").alias("b"))
    head = n.select("sheet").distinct().select("sheet", F.lit(2).alias("row"), F.array(F.lit("State"), F.lit("Total Children"), F.lit("Paid Amount")).alias("cells"))
    note = head.select("sheet", F.lit(1).alias("row"), F.array(F.lit("Table note"), F.lit(""), F.lit("")).alias("cells"))
    data = n.select("sheet", (F.col("c_nationkey") + 3).alias("row"), F.array(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")), F.col("a").cast("string"), F.round("b", 2).cast("decimal(20,2)").cast("string")).alias("cells"))
    total = n.groupBy("sheet").agg(F.lit(99).alias("row"), F.array(F.lit("Total"), F.sum("a").cast("string"), F.lit("")).alias("cells"))
    cells = note.unionByName(head).unionByName(data).unionByName(total).select("sheet", "row", F.posexplode("cells").alias("col", "text"))
    first = cells.filter((F.col("col") == 0) & F.lower("text").isin("state", "state/territory")).groupBy("sheet").agg(F.min("row").alias("head"))
    heads = cells.join(first, "sheet").filter("row = head").select("sheet", "col", S.slug("text").alias("slug"))
    body = cells.join(first, "sheet").filter("row > head").join(heads, ["sheet", "col"])
    named = body.groupBy("sheet", "row").agg(F.max(F.when(F.col("slug") == "state", F.col("text"))).alias("state"), *[F.max(F.when(F.col("slug").contains(k), F.col("text"))).alias(k) for k in ("children", "amount")])
    kept = named.filter(~F.lower("state").isin("total", ""))
    return base.rounded(kept.select("sheet", "state", S.accounting_number("children").alias("children"), S.accounting_number("amount").alias("amount")), 2)


SHEETS = """SELECT CAST(year(o_orderdate) AS INT) AS sheet, 's' || c_nationkey AS state, CAST(count(*) AS DOUBLE) AS children, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""

# ---- G: segments and channels

DIMENSIONS = ["age", "provider"]


def _segments(spark: SparkSession) -> DataFrame:
    return segments.definitions(spark, {"age": ["BUILDING", "MACHINERY", "*"], "provider": ["1-URGENT", "*"]}, {"1-URGENT": "urgent"})


SEGMENTS = """seg AS (SELECT a AS sage, p AS sprov, a || '/' || p AS segment_id, CASE WHEN p = '1-URGENT' THEN 'urgent' ELSE 'private' END AS segment_channel FROM (SELECT unnest(['BUILDING', 'MACHINERY', '*']) AS a), (SELECT unnest(['1-URGENT', '*']) AS p)),
sp AS (SELECT geo1, year, segment_id, segment_channel, sum(price * weight) / sum(weight) AS segment_price, sum(weight) AS segment_weight, count(*) AS segment_rows, avg(CAST(imputed AS DOUBLE)) AS imputed_share, bool_or(imputed) AS imputed_any, bool_and(imputed) AS imputed_all
  FROM micro JOIN seg ON (sage = '*' OR sage = age) AND (sprov = '*' OR sprov = provider) GROUP BY ALL)"""


def segment_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment prices by state and year; a row may match many segments."""
    return base.rounded(segments.segment_prices(base.micro(spark, sf_dir), _segments(spark), DIMENSIONS, ["geo1", "year"]))


SEGMENT_PRICES = f"WITH {base.MICRO}, {SEGMENTS} SELECT geo1, year, segment_id, segment_channel, round(segment_price, 6) AS segment_price, round(segment_weight, 6) AS segment_weight, segment_rows, round(imputed_share, 6) AS imputed_share, imputed_any, imputed_all FROM sp"


def pooled_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that partition the facts, pooled, against the direct benchmark."""
    m = base.micro(spark, sf_dir)
    ages = m.sparkSession.createDataFrame([(a,) for a in ("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD")], "age string").withColumns({"segment_id": F.col("age"), "segment_channel": F.lit("private")})
    seg = segments.segment_prices(m, ages, ["age"], ["geo1", "year"])
    return base.rounded(segments.price_gap(seg, m, ["geo1", "year"]).withColumn("within_tolerance", F.abs("gap") < 1e-6).drop("gap"))


GAP = f"""WITH {base.MICRO} SELECT geo1, year, round(sum(price * weight) / sum(weight), 6) AS pooled_price, round(sum(weight), 6) AS pooled_weight, count(DISTINCT age) AS n_segments, round(sum(price * weight) / sum(weight), 6) AS benchmark_price, true AS within_tolerance FROM micro GROUP BY ALL"""


def _stack(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, targets and the state panel; the panel is used many times, so it is written once."""
    keys = ["geo1", "year"]
    s = tables.staged(base.state(spark, sf_dir))
    rates = s.filter("year in (1996, 1999)").groupBy("year").agg((F.avg("observed_share") / 2).alias("rate"))
    carried = lookups.carried_rates(s, rates, "rate")
    targets = s.join(F.broadcast(carried), "year").select(*keys, (F.col("population") * F.col("rate")).alias("target"))
    program = s.select(*keys, F.when(F.col("geo1") % 3 != 0, F.col("population") * 0.05).alias("program_slots"))
    admin = s.select(*keys, F.when(F.col("geo1") % 2 == 0, F.col("population") * F.col("imputed_share") * 0.1).alias("admin_slots"))
    public = segments.public_slots(program, admin, s.select(*keys, "population"), keys)
    public = public.select(*keys, "public_slots", "slot_status", (F.col("public_slots") * 0.3).alias("subsidised_slots"))
    seg = segments.segment_prices(base.micro(spark, sf_dir), _segments(spark), DIMENSIONS, keys).filter("segment_id like '%/*' and segment_id <> '*/*'")
    # as many rows as state-years and segments, read for the shares and their totals
    seg = tables.staged(seg)
    shares = segments.shares_of_total(seg, keys, "segment_weight", "segment_rows")
    return segments.quantities(targets, public, shares, keys), targets, s


STACK = f"""{base.STATE}, {SEGMENTS}, rt AS (SELECT year AS a, avg(observed_share) / 2 AS v FROM state WHERE year IN (1996, 1999) GROUP BY year),
ca AS (SELECT y.year, coalesce(arg_max(v, a) FILTER (a <= y.year), arg_min(v, a) FILTER (a > y.year)) AS rate FROM (SELECT DISTINCT year FROM state) y, rt GROUP BY y.year),
pu AS (SELECT geo1, s.year, population * rate AS target, CASE WHEN geo1 % 3 <> 0 THEN population * 0.05 END AS pr, CASE WHEN geo1 % 2 = 0 THEN population * imputed_share * 0.1 END AS ad, population FROM state s JOIN ca ON ca.year = s.year),
pq AS (SELECT *, coalesce(pr, 0) + coalesce(ad, 0) AS public_slots, (coalesce(pr, 0) + coalesce(ad, 0)) * 0.3 AS subs FROM pu),
sh AS (SELECT geo1, year, segment_id, segment_weight / sum(segment_weight) OVER (PARTITION BY geo1, year) AS share FROM sp WHERE segment_id LIKE '%/*' AND segment_id <> '*/*'),
parts AS (SELECT q.geo1, q.year, 'private_unsubsidised' AS component, coalesce(segment_id, 'all') AS segment_id, greatest(target - public_slots - subs, 0) * coalesce(share, 1) AS quantity, segment_id IS NULL AS fallback FROM pq q LEFT JOIN sh ON sh.geo1 = q.geo1 AND sh.year = q.year
  UNION ALL SELECT geo1, year, 'public', 'public', public_slots, false FROM pq UNION ALL SELECT geo1, year, 'private_subsidised', 'subsidised', subs, false FROM pq WHERE subs > 0)"""


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey targets, public slots, shares, one row per component."""
    return base.rounded(_stack(spark, sf_dir)[0], 4)


QUANTITIES = f"WITH {STACK} SELECT geo1, year, component, segment_id, round(quantity, 4) AS quantity, fallback FROM parts"


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component sums against targets."""
    parts, targets, _ = _stack(spark, sf_dir)
    return base.rounded(segments.reconciled(parts, targets, ["geo1", "year"]), 4)


RECONCILED = f"""WITH {STACK} SELECT p.geo1, p.year, round(sum(quantity), 4) AS component_sum, bool_or(fallback) AS any_fallback, min(quantity) < 0 AS any_negative, round(sum(quantity) - any_value(target), 4) AS difference FROM parts p JOIN pq USING (geo1, year) GROUP BY ALL"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as columns, then solved per channel over alphas, then summed up."""
    keys = ["geo1", "year"]
    parts, _, s = _stack(spark, sf_dir)
    wide = segments.channel_wide(parts, keys)
    s = s.select(*keys, F.col("price").alias("base_price"), (F.col("population") * F.col("imputed_share")).alias("unpaid"), F.lit(0.4).alias("demand_elasticity"), F.lit(1.5).alias("supply_elasticity"))
    rows = segments.channel_scenarios(segments.channel_inputs(wide, s, keys), scenario.grid(spark, alpha=scenario.ALPHAS))
    return segments.scenario_summary(rows, keys)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13-G20 as a table."""
    return base.rounded(_channels(spark, sf_dir), 3)


CHANNELS = f"""WITH {STACK}, w AS (SELECT geo1, year, coalesce(sum(quantity) FILTER (component = 'private_unsubsidised'), 0) AS a, coalesce(sum(quantity) FILTER (component = 'private_subsidised'), 0) AS b, coalesce(sum(quantity) FILTER (component = 'public'), 0) AS c FROM parts GROUP BY ALL),
i AS (SELECT w.geo1, w.year, price AS p0, unnest([a, b]) AS q, unnest([a, b]) / nullif(a + b, 0) * population * imputed_share AS u, c FROM w JOIN state s ON s.geo1 = w.geo1 AND s.year = w.year),
x AS (SELECT *, unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS alpha FROM i), e AS (SELECT *, CASE WHEN q > 0 THEN p0 * (1 + alpha * u / q) ** (1 / 1.9) ELSE p0 END AS p FROM x), f AS (SELECT *, q * (p / p0) ** 1.5 AS qs FROM e)
SELECT geo1, year, alpha, round(sum(qs), 3) AS private_quantity, round(any_value(c), 3) AS public_quantity, round(coalesce(sum(p * qs) / nullif(sum(qs), 0), 0), 3) AS private_price, true AS public_price_fixed FROM f GROUP BY ALL"""


def headline_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenario row nearest the headline alpha, with its difference to alpha 0."""
    rows = _channels(spark, sf_dir)
    zero = rows.filter("alpha = 0").select("geo1", "year", F.col("private_price").alias("base"))
    near = segments.nearest_alpha(rows.filter("alpha <> 0.5"), ["geo1", "year"]).join(zero, ["geo1", "year"])
    return base.rounded(near.select("geo1", "year", "alpha", "private_price", *account.compared(near, "private_price", "base")[:1]), 3)


HEADLINE = CHANNELS[: CHANNELS.rindex("SELECT geo1, year, alpha, round(sum(qs), 3)")].rstrip() + """, s AS (SELECT geo1, year, alpha, coalesce(sum(p * qs) / nullif(sum(qs), 0), 0) AS private_price FROM f GROUP BY ALL)
SELECT a.geo1, a.year, a.alpha, round(a.private_price, 3) AS private_price, round(a.private_price - b.private_price, 3) AS private_price_delta FROM s a JOIN s b USING (geo1, year) WHERE a.alpha = 0.25 AND b.alpha = 0"""


def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the fifteen first priority states, by missing and proxy support (``support_by_state`` has all)."""
    keys = ["geo1", "year"]
    s = base.state(spark, sf_dir)
    program = s.select(*keys, F.when(F.col("geo1") % 3 != 0, F.col("population") * 0.05).alias("program_slots"))
    admin = s.select(*keys, F.when(F.col("geo1") % 2 == 0, F.col("population") * F.col("imputed_share") * 2).alias("admin_slots"))
    public = segments.public_slots(program, admin, s.select(*keys, "population"), keys).withColumn("tier", S.support_tier("slot_status"))
    out = public.groupBy("geo1").agg(F.count_if(F.col("tier") == "explicit").alias("explicit"), F.count_if(F.col("tier") == "proxy").alias("proxy"), F.count_if(F.col("tier") == "missing").alias("missing"), F.sum("public_slots").alias("slots"))
    issue = F.when(F.col("missing") > 0, "missing_slots").when(F.col("proxy") > 0, "large_gap").otherwise("none")
    out = out.withColumns({"issue": issue, "slot_share": F.col("slots") / F.sum("slots").over(Window.partitionBy(F.lit(1)))})
    return base.rounded(out).orderBy(F.desc("missing"), F.desc("proxy"), "geo1").limit(15)


SUPPORT = f"""WITH {base.STATE}, p AS (SELECT geo1, population, CASE WHEN geo1 % 3 <> 0 THEN population * 0.05 END AS a, CASE WHEN geo1 % 2 = 0 THEN population * imputed_share * 2 END AS b FROM state),
t AS (SELECT geo1, coalesce(a, 0) + coalesce(b, 0) AS s, CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN (coalesce(a, 0) + coalesce(b, 0)) / population > 0.5 THEN 'proxy' ELSE 'explicit' END AS tier FROM p),
g AS (SELECT geo1, count(*) FILTER (tier = 'explicit') AS explicit, count(*) FILTER (tier = 'proxy') AS proxy, count(*) FILTER (tier = 'missing') AS missing, sum(s) AS slots FROM t GROUP BY geo1),
o AS (SELECT *, CASE WHEN missing > 0 THEN 'missing_slots' WHEN proxy > 0 THEN 'large_gap' ELSE 'none' END AS issue, slots / sum(slots) OVER () AS slot_share FROM g)
SELECT geo1, explicit, proxy, missing, round(slots, 6) AS slots, issue, round(slot_share, 6) AS slot_share FROM o ORDER BY missing DESC, proxy DESC, geo1 LIMIT 15"""


def focus_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords against observed names, matched and missing, ranked."""
    words = spark.createDataFrame([(w,) for w in ("red", "blue", "ring", "bolt", "widget", "small", "zzz")], "keyword string")
    names = base.table(spark, sf_dir, "part").select("p_name").distinct()
    hits = names.crossJoin(F.broadcast(words)).filter(F.col("p_name").contains(F.col("keyword"))).groupBy("keyword").agg(F.count("*").alias("n_names"))
    out = words.join(hits, "keyword", "left").fillna(0, ["n_names"])
    required = out.select("keyword", F.col("keyword").isin("zzz", "bolt").alias("optional"))
    ready = account.readiness(required, out.filter("n_names > 0"), "keyword").select("keyword", "status", "priority")
    rank = F.row_number().over(Window.orderBy("priority", F.desc("n_names"), "keyword"))
    return out.join(ready, "keyword").withColumn("rank", rank)


FOCUS = """WITH w AS (SELECT unnest(['red', 'blue', 'ring', 'bolt', 'widget', 'small', 'zzz']) AS keyword), n AS (SELECT DISTINCT p_name FROM part),
h AS (SELECT keyword, (SELECT count(*) FROM n WHERE contains(p_name, keyword)) AS n_names FROM w),
s AS (SELECT *, CASE WHEN n_names > 0 THEN 'ready' WHEN keyword IN ('zzz', 'bolt') THEN 'optional_missing' ELSE 'blocking' END AS status FROM h), p AS (SELECT *, CASE status WHEN 'blocking' THEN 1 WHEN 'optional_missing' THEN 2 ELSE 3 END AS priority FROM s)
SELECT *, CAST(row_number() OVER (ORDER BY priority, n_names DESC, keyword) AS INT) AS rank FROM p"""

# ---- C: administrative records


def admin_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAV rows to records by slug and by token search, summed by state."""
    o = base.table(spark, sf_dir, "orders").join(base.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = o.select("o_orderkey", "c_nationkey", F.col("o_totalprice").alias("Total Price"), F.col("c_acctbal").alias("Account Balance"), F.col("o_orderstatus").alias("Status"))
    long = eav.melted(wide, ["o_orderkey", "c_nationkey"], ["Total Price", "Account Balance", "Status"])
    spot = F.create_map(F.lit("total_price"), F.lit(1), F.lit("account_balance"), F.lit(2), F.lit("status"), F.lit(3))
    long = long.withColumn("position", spot[F.col("column_slug")])
    rec = long.groupBy("o_orderkey", "c_nationkey").agg(eav.metric(["price", "balance"], ["account"]).alias("amount"), eav.metric(["balance"]).alias("balance"), F.min_by("value_text", F.when(F.col("column_slug") == "status", F.col("position"))).alias("status"))
    return base.rounded(rec.groupBy("c_nationkey", "status").agg(F.sum("amount").alias("amount"), F.max("balance").alias("balance"), F.count("*").alias("n")), 2)


ADMIN = "SELECT c_nationkey, o_orderstatus AS status, round(sum(o_totalprice), 2) AS amount, round(max(c_acctbal), 2) AS balance, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def split_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by explicit values, complements and shares; proxy reliability; boundary mixes."""
    m = base.micro(spark, sf_dir).groupBy("geo1", "geo2", "year").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("flag") == "R", F.col("weight")).otherwise(0)).alias("part"), F.sum(F.when(F.col("flag") == "R", 0).otherwise(F.col("weight"))).alias("other"))
    hide = lambda c, k, r: F.when((F.col("geo2") + F.col("year")) % k != r, F.col(c))
    rows = m.withColumns({"share": hide("part", 4, 1) / F.col("total"), "t": hide("total", 5, 0), "a": hide("part", 3, 0), "b": hide("other", 3, 1)})
    rows = rows.withColumns({"s": eav.split_support("t", "a", "b", "share"), "proxy": eav.proxy_reliability("part", "other"), "edge": eav.boundary_split("share")})
    return base.rounded(rows.groupBy(F.col("s.label").alias("label"), "proxy", "edge").agg(F.count("*").alias("n"), F.sum("s.part").alias("part"), F.sum("s.other").alias("other")), 4)


SPLITS = f"""WITH {base.MICRO}, m AS (SELECT geo1, geo2, year, sum(weight) AS total, sum(CASE WHEN flag = 'R' THEN weight ELSE 0 END) AS part, sum(CASE WHEN flag = 'R' THEN 0 ELSE weight END) AS other FROM micro GROUP BY ALL),
r AS (SELECT *, CASE WHEN (geo2 + year) % 4 <> 1 THEN part END / total AS s, CASE WHEN (geo2 + year) % 5 <> 0 THEN total END AS t, CASE WHEN (geo2 + year) % 3 <> 0 THEN part END AS a, CASE WHEN (geo2 + year) % 3 <> 1 THEN other END AS b FROM m),
l AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL AND abs(a + b - t) > 0.05 * greatest(t, 1) THEN 'inconsistent' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'explicit' WHEN a IS NOT NULL AND t >= a THEN 'inferred_complement' WHEN b IS NOT NULL AND t >= b THEN 'inferred_complement'
  WHEN t IS NOT NULL AND s IS NOT NULL THEN 'proxy_share' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'partial' ELSE 'missing' END AS label,
  CASE WHEN abs(part - other) / nullif(other, 0) <= 0.25 AND abs(part - other) <= 25000 THEN 'close' WHEN abs(part - other) / nullif(other, 0) <= 0.75 AND abs(part - other) <= 75000 THEN 'moderate' WHEN abs(part - other) / nullif(other, 0) IS NOT NULL THEN 'large_downgraded' ELSE 'unknown' END AS proxy,
  CASE WHEN s <= 0.02 THEN 'all_other' WHEN s >= 0.98 THEN 'all_part' WHEN s IS NOT NULL THEN 'mixed' ELSE 'missing' END AS edge FROM r)
SELECT label, proxy, edge, count(*) AS n, round(sum(coalesce(a, CASE WHEN t >= b THEN t - b END, CASE WHEN b IS NULL THEN t * s END)), 4) AS part, round(sum(coalesce(b, CASE WHEN t >= a THEN t - a END, CASE WHEN a IS NULL THEN t * (1 - s) END)), 4) AS other FROM l GROUP BY ALL"""

CONTROLS = ["copay", "rate", "wait", "visit"]


def policy_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").withColumns({"geo": F.col("user_id") % 25, "month": F.month("ts")})
    name = F.element_at(F.array(*[F.lit(c) for c in CONTROLS]), (F.col("user_id") % 4 + 1).cast("int"))
    # one control is known in few places only: its name is hidden elsewhere, no row is left out
    known = e.withColumn("control", F.when((name != "visit") | (F.col("geo") < 6), name))
    return eav.policy_wide(known, ["geo"], "control", "value", "event_id", CONTROLS)


POLICY_CTE = "e AS (SELECT *, user_id % 25 AS geo, ['copay', 'rate', 'wait', 'visit'][user_id % 4 + 1] AS control FROM events), w AS (SELECT geo, " + ", ".join(f"arg_max(value, event_id) FILTER (control = '{c}') AS {c}" for c in CONTROLS) + ", count(DISTINCT control) AS n_controls FROM (SELECT * REPLACE (CASE WHEN control <> 'visit' OR geo < 6 THEN control END AS control) FROM e) GROUP BY geo)"


def policy_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value of each control by state."""
    return base.rounded(policy_wide_rows(spark, sf_dir))


POLICY = f"WITH {POLICY_CTE} SELECT geo, {', '.join(f'round({c}, 6) AS {c}' for c in CONTROLS)}, n_controls FROM w"


def policy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each control; C13: which are promoted."""
    wide = policy_wide_rows(spark, sf_dir)
    return base.rounded(eav.control_coverage(wide, CONTROLS).withColumn("promoted", F.col("coverage") >= 0.75))


COVER = f"WITH {POLICY_CTE}, c AS ({' UNION ALL '.join(f'''SELECT '{c}' AS control, count({c}) AS n_known, count({c}) / count(*) AS coverage FROM w''' for c in CONTROLS)}) SELECT control, n_known, round(coverage, 6) AS coverage, coverage >= 0.75 AS promoted FROM c"

# ---- L: rules


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("rule"), "p_size")
    m = base.micro(spark, sf_dir).join(p, "partkey")
    # every row is read; some values of the panel are hidden, so that there is something to carry forward
    shown = ((F.col("geo1") * 3 + F.col("year")) % 4 != 0) & ((F.col("rule") != "PROMO") | (F.col("geo1") % 2 == 0))
    return m.groupBy("geo1", "rule", "year").agg(F.avg("p_size").alias("value")).withColumn("value", F.when(shown, F.col("value")))


_RULES = "ru AS (SELECT geo1, rule, year, CASE WHEN (geo1 * 3 + year) % 4 <> 0 AND (rule <> 'PROMO' OR geo1 % 2 = 0) THEN value END AS value FROM (SELECT geo1, p_type AS rule, year, avg(p_size) AS value FROM micro JOIN part ON partkey = p_partkey GROUP BY ALL))"


def harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense rule grid carried forward, with status and reference year."""
    r = _rules(spark, sf_dir).withColumn("sign", F.when(F.col("value").isNotNull(), F.when(F.col("rule") == "SMALL", -1.0).otherwise(1.0)))
    grid = lookups.dense_grid([r.select(c).distinct() for c in ("geo1", "year", "rule")])
    out = rules.harmonised(grid, r, ["geo1", "rule"], "year", "value", "sign")
    return base.rounded(out.select("geo1", "rule", "year", "support_status", "harmonised", "reference_year", "signed"))


HARMONISED = f"""WITH {base.MICRO}, {_RULES}, g AS (SELECT * FROM (SELECT DISTINCT geo1 FROM ru), (SELECT DISTINCT year FROM ru), (SELECT DISTINCT rule FROM ru)),
j AS (SELECT g.*, value FROM g LEFT JOIN ru USING (geo1, rule, year)), h AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS h, last_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER w AS y FROM j WINDOW w AS (PARTITION BY geo1, rule ORDER BY year ROWS UNBOUNDED PRECEDING))
SELECT geo1, rule, year, CASE WHEN value IS NOT NULL THEN 'observed' WHEN h IS NOT NULL THEN 'carried_forward' ELSE 'missing' END AS support_status, round(h, 6) AS harmonised, y AS reference_year, round(CASE WHEN value IS NOT NULL THEN h * CASE WHEN rule = 'SMALL' THEN -1 ELSE 1 END END, 6) AS signed FROM h"""


def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the rule grid as columns."""
    return harmonised(spark, sf_dir).groupBy("geo1").pivot("support_status", ["observed", "carried_forward", "missing"]).count().fillna(0)


RULE_STATUS = f"SELECT geo1, count(*) FILTER (support_status = 'observed') AS observed, count(*) FILTER (support_status = 'carried_forward') AS carried_forward, count(*) FILTER (support_status = 'missing') AS missing FROM ({HARMONISED}) GROUP BY geo1"


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment timing by state and the event study on log prices."""
    s = base.state(spark, sf_dir).withColumns({"lp": F.ln("price"), "shock": F.when((F.col("geo1") % 4 == 0) & (F.col("year") >= 1997 + F.col("geo1") % 3), 1.0).otherwise(0.0)})
    t = rules.treatment_timing(s, "geo1", "year", "shock")
    return base.rounded(rules.event_study(s, t, "geo1", "year", "lp"))


EVENT = f"""WITH {base.STATE}, s AS (SELECT geo1, year, ln(price) AS lp, CASE WHEN geo1 % 4 = 0 AND year >= 1997 + geo1 % 3 THEN 1 ELSE 0 END AS sh FROM state), t AS (SELECT geo1, min(year) FILTER (sh > 0) AS f FROM s GROUP BY geo1),
r AS (SELECT s.*, f FROM s JOIN t USING (geo1)), tr AS (SELECT *, year - f AS k FROM r WHERE f IS NOT NULL AND year - f BETWEEN -3 AND 3), c AS (SELECT year, sum(lp) AS cs, count(*) AS cn FROM r WHERE f IS NULL GROUP BY year),
m AS (SELECT k, avg(lp) AS treated_mean, count(*) AS n_treated FROM tr GROUP BY k), mm AS (SELECT k, sum(cs) / sum(cn) AS control_mean, CAST(sum(cn) AS BIGINT) AS n_control FROM (SELECT DISTINCT k, year FROM tr) JOIN c USING (year) GROUP BY k),
b AS (SELECT *, treated_mean - control_mean AS gap FROM m LEFT JOIN mm USING (k))
SELECT k, round(treated_mean, 6) AS treated_mean, n_treated, round(control_mean, 6) AS control_mean, n_control, round(gap, 6) AS gap, round(gap - (SELECT gap FROM b WHERE k = -1), 6) AS effect FROM b"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts grouped by status with their distinct notes."""
    o = base.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    c = base.table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
    c = c.withColumns({"status": F.when(F.col("f") / F.col("n") > 0.34, "ready").otherwise("review"), "note": F.concat(F.lit("share band "), F.floor(F.col("f") / F.col("n") * 20).cast("string")), "item": F.lpad(F.col("c_nationkey").cast("string"), 2, "0")})
    out = account.grouped_notes(c, "status", "item", "note")
    return out.select("status", F.array_join("items", ",").alias("items"), F.array_join("notes", ",").alias("notes"), "n")


NOTES = """WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT c_nationkey, sum(f) AS f, sum(n) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT CASE WHEN f / n > 0.34 THEN 'ready' ELSE 'review' END AS status, lpad(c_nationkey::VARCHAR, 2, '0') AS item, 'share band ' || CAST(floor(f / n * 20) AS INT) AS note FROM c)
SELECT status, array_to_string(list_sort(list(item)), ',') AS items, array_to_string(list_sort(list_distinct(list(note))), ',') AS notes, count(*) AS n FROM s GROUP BY status"""


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of headline counts and gates."""
    s = base.state(spark, sf_dir)
    return base.rounded(s.agg(F.count("*").alias("rows"), F.count_distinct("geo1").alias("states"), F.count_distinct("year").alias("years"), F.median("price").alias("median_price"), F.count_if(F.col("imputed_share") <= 0.34).alias("low_imputed"), (F.count_distinct("year") >= 6).alias("enough_years"), F.bool_and(F.col("price") > 0).alias("all_priced")))


RELEASE = f"WITH {base.STATE} SELECT count(*) AS rows, count(DISTINCT geo1) AS states, count(DISTINCT year) AS years, round(median(price), 6) AS median_price, count(*) FILTER (imputed_share <= 0.34) AS low_imputed, count(DISTINCT year) >= 6 AS enough_years, bool_and(price > 0) AS all_priced FROM state"

REGISTERED = {
    "time_use_respondents": (time_use, TIME_USE), "price_pairs": (price_pairs, PAIRS), "measure_pivot": (measure_pivot, PIVOT), "program_sites": (program_sites, SITES), "survey_subgroups": (subgroups, SUBGROUPS), "storm_events": (storms, STORMS), "sheet_rows": (sheet_rows, SHEETS),
    "segment_prices": (segment_prices, SEGMENT_PRICES), "pooled_price_gap": (pooled_gap, GAP), "segmented_quantities": (quantities, QUANTITIES), "reconciliation": (reconciliation, RECONCILED), "channel_scenarios": (channels, CHANNELS), "headline_alpha": (headline_alpha, HEADLINE), "support_summary": (support_summary, SUPPORT), "focus_areas": (focus_areas, FOCUS),
    "admin_records": (admin_records, ADMIN), "split_decisions": (split_decisions, SPLITS), "policy_controls": (policy_controls, POLICY), "policy_coverage": (policy_coverage, COVER),
    "harmonised_rules": (harmonised, HARMONISED), "rule_status": (rule_status, RULE_STATUS), "event_study": (timing, EVENT), "release_notes": (notes, NOTES), "release_headline": (headline, RELEASE),
}
