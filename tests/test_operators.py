from fractions import Fraction as Q

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import weighted as W
from tessera.operators import eav, effects, impute, ladders, lookups, moments, quantiles, rules, scenario, supply, switching


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (lambda: S.padded_code(F.lit("123456"), 5), "123456"), (lambda: S.padded_code(F.lit(7), 2), "07"), (lambda: S.coerced_code(F.lit("6.0"), 2), "06"),
        (lambda: S.coerced_code(F.lit("US-06037"), 5), "06037"), (lambda: S.coerced_code(F.lit("x"), 5), None), (lambda: S.slug(F.lit(" A--b C! ")), "a_b_c"),
        (lambda: S.county_key(F.lit("Ste. Genevieve County")), "st genevieve"), (lambda: S.magnitude_money(F.lit("1.5M")), 1.5e6), (lambda: S.magnitude_money(F.lit("bad")), 0.0),
        (lambda: S.accounting_number(F.lit("($1,234.5)")), -1234.5), (lambda: S.accounting_number(F.lit("-")), None), (lambda: S.suppressed_count(F.lit("1,234*")), 1234.0),
        (lambda: S.share(F.lit(45.0)), 0.45), (lambda: S.share(F.lit(101.0)), None), (lambda: S.yes_no(F.lit("2")), False), (lambda: S.year_in(F.lit("no"), F.lit("FY2021 b")), 2021),
        (lambda: S.effective_years(F.lit(2015), F.lit(2999), F.lit(2017)), [2015, 2016, 2017]), (lambda: S.effective_years(F.lit(2015), F.lit(2010), F.lit(2017)), [2015]),
        (lambda: S.support_tier(F.lit("proxy_share_downgraded")), "proxy"), (lambda: S.use_tier(F.lit(12.0), F.lit(6), F.lit(40)), "headline"), (lambda: S.semantic_type(F.lit("annual_price")), "money"),
    ],
)
def test_scalars(spark, expression, want):
    assert one(spark, expression()) == want


def test_weighted_means_on_missing_data(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, None)], "v double, w double")
    a2, a3, a4 = df.agg(W.weighted_mean_or_mean("v", "w"), W.weighted_mean_or_null("v", "w"), W.weighted_mean_nulls_zero("v", "w")).first()
    assert (a2, a3, a4) == (2.0, None, 0.0)
    with pytest.raises(Exception, match="weights sum to zero"):
        spark.createDataFrame([(1.0, 0.0)], "v double, w double").agg(W.weighted_mean_strict("v", "w")).first()


def test_weighted_median_without_weight(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (1, 7.0, 0.0), (2, 1.0, 1.0), (2, 9.0, 3.0)], "g int, v double, w double")
    assert sorted(map(tuple, W.weighted_median(df, ["g"], "v", "w").collect())) == [(1, 6.0), (2, 9.0)]


def test_median_ladder_takes_the_ratio_once(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 1.0), (1, 1, 10.0, None), (1, 2, 10.0, None), (2, 2, 10.0, None), (2, 3, None, None)], "s int, y int, b double, v double")
    out = impute.fill_from_group_medians(df, "v", "b", "source", [("state_year", ["s", "y"]), ("state", ["s"]), ("national", [])])
    assert sorted((r.s, r.y, r.v, r.source) for r in out.filter("v is null or source <> 'observed'").collect() if r.v) == [(1, 1, 1.0, "state_year"), (1, 2, 1.0, "state"), (2, 2, 1.0, "national")]
    assert out.filter("source = 'missing'").count() == 1


def test_first_reason_counts_null_as_failing(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 2), (1.0, 9)], "p double, y int")
    out = df.select(ladders.first_reason([("window", F.col("y") > 5), ("price", F.col("p") <= 0)]).alias("r"))
    assert [r.r for r in out.collect()] == ["eligible", "price", "window"]


def test_wildcards_match_many(spark):
    facts = spark.createDataFrame([("a", "x"), ("b", "y")], "d1 string, d2 string")
    seg = spark.createDataFrame([("*", "*", "all"), ("a", "*", "a"), ("*", "y", "y")], "d1 string, d2 string, segment_id string")
    assert sorted(map(tuple, lookups.wildcard_join(facts, seg, ["d1", "d2"]).collect())) == [("a", "x", "a"), ("a", "x", "all"), ("b", "y", "all"), ("b", "y", "y")]


def test_solver_statuses_and_piecewise(spark):
    rows = [(100.0, 10.0, 5.0, 0.5, 0.3, 1.5), (-1.0, 10.0, 5.0, 0.5, 0.3, 1.5), (100.0, 10.0, 0.0, 1.0, 0.3, 1.5), (None, 10.0, 5.0, 0.5, 0.3, 1.5), (100.0, 1e-9, 1e9, 1.0, 0.0, 0.001)]
    df = spark.createDataFrame(rows, "base_price double, market double, unpaid double, alpha double, demand_elasticity double, supply_elasticity double")
    a, b, c, d, e = [r.s for r in df.select(scenario.solved().alias("s")).collect()]
    assert a.price == pytest.approx(100 * 1.25 ** (1 / 1.8)) and a.status == "converged"
    assert b.status == "invalid_input" and b.price is None and d.status == "invalid_input" and e.status == "unbracketed"
    assert c.price == pytest.approx(100.0)
    same = df.limit(1).withColumns({"k": F.lit(0.0), "above": F.col("supply_elasticity")}).select(scenario.solved(entry="k", cost="k")["price"], scenario.solved(above="above")["price"], scenario.solved_natively()).first()
    assert same[0] == pytest.approx(a.price) and same[1] == pytest.approx(a.price) and same[2] == pytest.approx(a.price, rel=1e-12)


def two_stage_directly(z, p, y, c, w):
    def fit(x, t):
        s = np.sqrt(w)[:, None]
        return np.linalg.lstsq(x * s, t * s[:, 0], rcond=None)[0]

    one_ = np.ones(len(z))
    first = np.column_stack([one_, z, c])
    b1 = fit(first, p)
    b2 = fit(np.column_stack([one_, first @ b1, c]), y)
    return b1, b2


def test_two_stage_and_held_out_equal_refits(spark):
    r = np.random.default_rng(1)
    n = 240
    g, z, c, w = r.integers(0, 8, n), r.normal(size=n), r.normal(size=n), r.uniform(0.5, 2, n)
    p = 1 + 0.8 * z + 0.3 * c + r.normal(size=n)
    y = 5 - 0.5 * p + 0.2 * c + r.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(g, z, p, y, c, w)], "g double, z double, p double, y double, c double, w double")
    fit = moments.two_stage_fits(moments.moment_rows(df.withColumn("all", F.lit("a")), ["z", "p", "y", "c"], F.col("w"), ["all"]), [("all", "string")]).first()
    _, b2 = two_stage_directly(z, p, y, c, w)
    assert fit.price_coefficient == pytest.approx(b2[1], rel=1e-6) and fit.n_obs == n
    out = moments.leave_one_out(moments.moment_rows(df.withColumn("all", F.lit("a")), ["z", "p", "y", "c"], F.col("w"), ["all", "g"]), [("all", "string")], "g").first()
    error, elasticities = 0.0, []
    for k in range(8):
        a, b = g != k, g == k
        b1, b2 = two_stage_directly(z[a], p[a], y[a], c[a], w[a])
        hat = np.column_stack([np.ones(b.sum()), np.column_stack([np.ones(b.sum()), z[b], c[b]]) @ b1, c[b]]) @ b2
        error += (w[b] * (y[b] - hat) ** 2).sum()
        elasticities.append(b2[1] * np.average(p[b], weights=w[b]) / np.average(y[b], weights=w[b]))
    assert out.rmse == pytest.approx(np.sqrt(error / w.sum()), rel=1e-5)
    assert out.elasticity_min == pytest.approx(min(elasticities), rel=1e-4) and out.groups == 8


def test_two_way_demeaning_and_clustered_errors(spark):
    r = np.random.default_rng(2)
    rows = [(int(a), int(b), float(r.normal() + a + 2 * b), float(r.normal())) for a in range(6) for b in range(5) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "a int, b int, y double, x double")
    got = {(q.a, q.b): q.d_y for q in effects.absorbed(df, ["y"], "a", "b").collect()}
    dummies = np.array([[*(a == i for i in range(6)), *(b == j for j in range(5))] for a, b, *_ in rows], float)
    y = np.array([q[2] for q in rows])
    want = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
    assert [got[q[:2]] for q in rows] == pytest.approx(list(want), abs=1e-8)
    out = supply.clustered_slope(df, "y", "x", "a").first()
    x = np.array([q[3] for q in rows])
    beta = x @ y / (x @ x)
    meat = sum((x[m] @ (y - beta * x)[m]) ** 2 for m in ([q[0] == k for q in rows] for k in range(6)))
    assert out.beta == pytest.approx(beta) and out.se == pytest.approx(np.sqrt(meat) / (x @ x))


def test_rule_grid_carries_forward(spark):
    grid = spark.range(2018, 2023).select(F.lit("a").alias("r"), F.col("id").cast("int").alias("year"))
    seen = spark.createDataFrame([("a", 2019, 3.0, -1.0), ("a", 2021, 4.0, -1.0)], "r string, year int, v double, s double")
    out = rules.harmonised(grid, seen, ["r"], "year", "v", "s").orderBy("year").collect()
    assert [(x.support_status, x.harmonised, x.reference_year, x.signed) for x in out] == [
        ("missing", None, None, None), ("observed", 3.0, 2019, -3.0), ("carried_forward", 3.0, 2019, None), ("observed", 4.0, 2021, -4.0), ("carried_forward", 4.0, 2021, None),
    ]


def test_principal_component_follows_the_index(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=50)
    df = spark.createDataFrame([(i, float(b + 0.1 * r.normal()), float(2 * b), 5.0) for i, b in enumerate(base)], "k int, a double, b double, c double")
    got = [x.first_component for x in moments.principal_component(df, ["a", "b", "c"], ["k"]).orderBy("k").collect()]
    assert np.corrcoef(got, base)[0, 1] > 0.99


def test_records_and_split(spark):
    df = spark.createDataFrame([(1, "x", "12", " "), (2, None, "n/a", "7")], "id int, A string, `B b` string, C string")
    long = eav.melted(df, ["id"], ["A", "B b", "C"])
    assert sorted((r.id, r.column_slug, r.value_numeric) for r in long.collect()) == [(1, "a", None), (1, "b_b", 12.0), (2, "b_b", None), (2, "c", 7.0)]
    s = spark.createDataFrame([(10.0, 4.0, None, None), (10.0, 9.0, 9.0, None), (10.0, None, None, 0.3)], "t double, a double, b double, s double")
    assert [tuple(r.x) for r in s.select(eav.split_support("t", "a", "b", "s").alias("x")).collect()] == [(4.0, 6.0, "inferred_complement"), (9.0, 9.0, "inconsistent"), (3.0, 7.0, "proxy_share")]


def test_bootstrap_rejects_draws_by_reason(spark):
    """A draw with a wrong sign on either side is counted and not solved; the others give each row's interval."""
    from tessera.operators import scenario, simulation
    from tessera.sources import tables

    fits = spark.createDataFrame([(0, 0.5, 1.0, None), (1, 0.5, 2.0, None), (2, None, 1.0, "demand_fit"), (3, 0.5, -1.0, "supply_fit")], "draw int, demand_elasticity double, supply_elasticity double, reason string")
    rows = spark.createDataFrame([(1, 10.0, 4.0, 4.0), (2, 20.0, 4.0, 0.0)], "id int, base_price double, market double, unpaid double")
    draws, record = simulation.bootstrap_prices(rows, fits, scenario.grid(spark, alpha=(1.0,)), tables.staged)
    got = {r.id: r for r in simulation.intervals(draws, ["id"], 0.0, 1.0).collect()}
    assert got[2].price_lower == got[2].price_upper == pytest.approx(20.0) and got[1].n_draws == 2
    assert got[1].price_upper == pytest.approx(10 * 2 ** (1 / 1.5)) and got[1].price_lower == pytest.approx(10 * 2 ** (1 / 2.5))
    (r,) = simulation.bootstrap_record(record).collect()
    assert (r.requested, r.accepted, r.rejected_demand_fit, r.rejected_supply_fit, r.rejected_solver, r.passed) == (4, 2, 1, 1, 0, False)
    # no root within 128 times the price: the whole draw goes
    steep = spark.createDataFrame([(0, 0.001, 0.001, None), (1, 0.5, 1.0, None)], fits.schema)
    draws, record = simulation.bootstrap_prices(rows, steep, scenario.grid(spark, alpha=(1.0,)), tables.staged)
    assert {tuple(r.draws) for r in draws.collect()} == {(1,)} and {r.reason for r in record.collect()} == {None, "solver"}


def test_fits_keep_their_digits_with_a_weak_instrument():
    """Moments of whole numbers far from 0 against fractions: first-stage F and second stage."""
    n = 400
    z = [100_000 + i % 20 for i in range(n)]
    p = [100_000 + 50 * (i * i % 101) + z[i] % 20 // 6 for i in range(n)]
    y = [100_000 + (i * 7 % 31) - 3 * (p[i] - 100_000) for i in range(n)]
    columns = [[1] * n, z, p, y]
    m = [float(sum(a * b for a, b in zip(columns[i], columns[j], strict=True))) for i in range(4) for j in range(i, 4)]
    mean = lambda v: Q(sum(v), n)
    s = lambda u, v: sum(Q(a) * b for a, b in zip(u, v, strict=True)) - n * mean(u) * mean(v)
    slope = s(z, y) / s(z, p)
    got = moments.two_stage(m, n)
    e1 = s(p, p) - s(z, p) ** 2 / s(z, z)
    assert got["first_stage_f"] == pytest.approx(float(s(z, p) ** 2 / s(z, z) * (n - 2) / e1), rel=1e-6)
    assert got["price_coefficient"] == pytest.approx(float(slope), rel=1e-6)


def test_a_column_that_does_not_vary_gets_nothing(spark):
    """A constant regressor gets 0, and one that repeats a status shares its effect by least coefficients."""
    rows = spark.range(3000).selectExpr("cast(id % 7 as double) as x", "cast(0.3 as double) as days", "cast(id % 3 = 0 as double) as late", "0.3 * cast(id % 3 = 0 as double) as late_days", "2.0 + 0.5 * (id % 7) + 1.09 * cast(id % 3 = 0 as double) as y")
    got = {r["name"]: r["value"] for r in switching.coefficients(rows, "y", ["x", "days", "late", "late_days"]).collect()}
    want = {"constant": 2.0, "x": 0.5, "days": 0.0, "late": 1.0, "late_days": 0.3}
    assert got == pytest.approx(want, abs=1e-6)


def test_buckets_do_not_grow(spark, monkeypatch):
    """However many values a group has, no bucket holds more than its share, and the quantiles stay exact."""
    monkeypatch.setattr(quantiles, "BUCKET_BITS", 6)
    monkeypatch.setattr(quantiles, "PART", 500)
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id % 3) as g", "cast((id * 7919) % 6007 as double) as v", "cast(id % 5 as double) as w")
    cells = quantiles._cells(df, ["g"], "v", "w")
    assert cells.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 64
    got = {r.g: (r.low, r.m, r.half) for r in quantiles.summary(df, ["g"], "v", "w", {"low": 0.1, "m": 0.5}, "half").collect()}
    rows = df.collect()
    for g in (None, 1, 2):
        own = sorted((r.v, r.w) for r in rows if r.g == g)
        v, w = np.array(own).T
        assert np.allclose(got[g], (np.quantile(v, 0.1), np.median(v), v[np.searchsorted(np.cumsum(w), w.sum() / 2)]))
