"""Two-way effects, the supply IV, the switching model, coefficient errors and gates, and exact quantiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import effects, moments, quantiles, switching
from tessera.sources import tables


def residuals(dummies, v):
    return v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]


@pytest.fixture(scope="module")
def design(spark):
    r = np.random.default_rng(4)
    rows = []
    for unit in range(60):
        state, exposure = unit % 5, r.uniform()
        for year in range(2010, 2017):
            if r.random() < 0.75:  # unbalanced on purpose
                shock = 0.0 if state in (0, 1) else max(0, year - 2012 - state % 2) * 0.3
                x = exposure * shock
                price = np.exp(1 + 0.5 * x + 0.1 * r.normal() + 0.2 * (year - 2010) * state)
                density = np.exp(2 - 0.8 * x + 0.1 * r.normal())
                rows.append((state, unit, year, shock, 2010, float(x), float(price), float(density), None if r.random() < 0.2 else float(r.uniform(1, 9)), 100.0))
    df = spark.createDataFrame(rows, "geo1 int, geo2 int, year int, shock double, base_year int, instrument double, price double, density double, establishments double, population double")
    return rows, effects.supply_iv_panel(df)


def test_supply_iv_equals_dummies(design):
    rows, panel = design
    out = effects.supply_iv(tables.staged(panel)).first()
    state, unit, year = (np.array([q[i] for q in rows]) for i in (0, 1, 2))
    dummies = np.column_stack([*[unit == u for u in np.unique(unit)], *[(state == s) & (year == y) for s in np.unique(state) for y in np.unique(year)]]).astype(float)
    x = residuals(dummies, np.array([q[5] for q in rows]))
    employer = np.array([np.nan if q[8] is None else np.log(q[8] * 1000 / q[9]) for q in rows])
    betas = {}
    for name, y in (("price", np.log([q[6] for q in rows])), ("provider", np.log([q[7] for q in rows])), ("employer", employer)):
        ok = ~np.isnan(y)
        yr, xr = residuals(dummies[ok], y[ok]), x[ok]
        beta = xr @ yr / (xr @ xr)
        meat = sum((xr[state[ok] == s] @ (yr - beta * xr)[state[ok] == s]) ** 2 for s in np.unique(state))
        assert out[f"{name}_beta"] == pytest.approx(beta, rel=1e-7) and out[f"{name}_se"] == pytest.approx(np.sqrt(meat) / (xr @ xr), rel=1e-6)
        assert (out[f"{name}_n_obs"], out[f"{name}_n_clusters"]) == (ok.sum(), 5)
        betas[name] = beta
    assert out.wald_provider == pytest.approx(betas["provider"] / betas["price"]) and out.wald_employer == pytest.approx(betas["employer"] / betas["price"])
    assert (out.status, out.scope, out.n_treated_states, out.treated_states, out.n_counties) == ("ok", "many_states", 3, "2,3,4", 60)


def test_supply_iv_without_variation(design):
    _, panel = design
    still = effects.supply_iv(tables.staged(panel.withColumns({"shock": F.lit(0.0), "instrument": F.lit(0.0)}))).first()
    assert (still.status, still.scope, still.wald_provider, still.first_stage) == ("insufficient_identification", "single_state_pilot", None, "weak_or_unknown")
    none = effects.supply_iv(tables.staged(panel.filter("year < 0"))).first()
    assert none.status == "insufficient_overlap" and none.n_panel == 0 and none.wald_provider is None


def test_switching_with_17_regressors(spark):
    r = np.random.default_rng(5)
    n, plain, crossed, last = 900, ["a", "b", "c", "storm", "rain", "u"], ["storm", "rain"], ["events", "damage"]
    status = r.choice(["observed", "national_avg_not_reported", "national_avg_nonmetro", "something"], n)
    x = {k: r.normal(size=n) for k in [*plain, *last]}
    y = (r.random(n) < 0.5 + 0.4 * x["a"]).astype(float)
    rows = [(float(y[i]), None if i % 50 == 0 and status[i] == "observed" else str(status[i]), *[float(x[k][i]) for k in [*plain, *last]]) for i in range(n)]
    df = spark.createDataFrame([*rows, (1.0, "observed", None, *[0.0] * 7)], "y double, status string, " + ", ".join(f"{k} double" for k in [*plain, *last]))
    out = switching.switching_summary(df, "y", plain, "status", crossed, last).first()
    levels = [(status == s).astype(float) for s in ("national_avg_not_reported", "national_avg_nonmetro", "something")]
    design = np.column_stack([np.ones(n), *[x[k] for k in plain], *levels, *[x[k] * s for k in crossed for s in levels], *[x[k] for k in last]])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = np.clip(design @ b, 0, 1)
    names = ["b_constant", *[f"b_{k}" for k in plain], *[f"b_status_{k}" for k in ("not_reported", "nonmetro", "other_fallback")]]
    assert design.shape[1] == 18 and [out[k] for k in names] == pytest.approx(list(b[:10]), abs=1e-6)
    assert out.effect_storm_observed == pytest.approx(b[4], abs=1e-6) and out.effect_rain_other_fallback == pytest.approx(b[5] + b[15], abs=1e-6)
    assert out.r2_in_sample == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and out.mean_predicted == pytest.approx(fit.mean())
    assert (out.n_obs, out.rows_observed, out.rows_other_fallback) == (n, (status == "observed").sum(), (status == "something").sum())


def test_two_stage_errors_and_reduced_form(spark):
    r = np.random.default_rng(6)
    n = 300
    z, c, w = r.normal(size=n), r.normal(size=n), r.uniform(0.5, 2, n)
    p = 10 + 0.8 * z + 0.3 * c + r.normal(size=n)
    y = 50 - 0.5 * p + 0.2 * c + r.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, q)) for q in zip(z, p, y, c, w)], "z double, p double, y double, c double, w double").withColumn("mode", F.lit("a"))
    fit = moments.two_stage_fits(moments.moment_rows(df, ["z", "p", "y", "c"], F.col("w"), ["mode"]), [("mode", "string")]).first()
    root = np.sqrt(w)[:, None]

    def least(x, t):
        return np.linalg.lstsq(x * root, t * root[:, 0], rcond=None)[0]

    first = np.column_stack([np.ones(n), z, c])
    b1 = least(first, p)
    second, actual = np.column_stack([np.ones(n), first @ b1, c]), np.column_stack([np.ones(n), p, c])
    b2, b3 = least(second, y), least(actual, y)
    variance = lambda x, e: np.linalg.inv((x * root).T @ (x * root))[1, 1] * (w * e**2).sum() / (n - 3)
    assert fit.first_stage_se == pytest.approx(np.sqrt(variance(first, p - first @ b1)), rel=1e-5) and fit.first_stage_coefficient == pytest.approx(b1[1], rel=1e-6)
    assert fit.price_se == pytest.approx(np.sqrt(variance(second, y - actual @ b2)), rel=1e-4)
    mean = np.average(y, weights=w)
    assert fit.reduced_form_r2 == pytest.approx(1 - (w * (y - actual @ b3) ** 2).sum() / (w * (y - mean) ** 2).sum(), rel=1e-5) and fit.avg_fitted == pytest.approx(np.average(second @ b2, weights=w))


def test_headline_is_the_first_sample_that_passes(spark):
    good = dict(n_obs=200, n_groups=20, n_years=8, first_stage_f=30.0, admissible=True, sign_consistent=True)
    rows = [dict(good, mode="low"), dict(good, mode="core"), dict(good, mode="broad"), dict(good, mode="few", n_obs=99)]
    pick = lambda rs: {r.mode: (r.headline_eligible, r.headline_rank, r.selected, r.reason) for r in moments.with_headline(spark.createDataFrame(rs), "mode", ["low", "core", "few"]).collect()}
    got = pick(rows)
    assert got["low"] == (True, 1, True, "first_to_pass") and got["core"] == (True, 2, False, "an_earlier_sample_passes")
    assert got["broad"] == (False, 4, False, "not_a_headline_sample") and got["few"] == (False, 3, False, "below_the_gates")
    for gate, bad in (("first_stage_f", 9.0), ("admissible", False), ("sign_consistent", False), ("n_years", 5), ("n_groups", 14)):
        assert pick([dict(rows[0], **{gate: bad}), *rows[1:]])["core"][2]


def weighted_median(v, w):
    v, w = v[np.argsort(v, kind="stable")], w[np.argsort(v, kind="stable")]
    if w.sum() <= 0:
        return np.median(v)
    return v[np.flatnonzero(np.cumsum(w) >= 0.5 * w.sum())[0]]


def test_quantiles_by_selection(spark):
    r = np.random.default_rng(7)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # one group holds most rows, one a single value, one no weight; a null key is a group
        v = {"hot": np.round(r.lognormal(0, 3, 4000), 2), "same": np.full(300, 7.0), "free": r.normal(size=41), None: r.integers(0, 5, 60).astype(float), "one": np.array([3.5])}
        w = {k: np.zeros(len(x)) if k == "free" else r.integers(0, 4, len(x)).astype(float) for k, x in v.items()}
        rows = [(k, float(a), float(b)) for k in v for a, b in zip(v[k], w[k])] + [("hot", None, 1.0), ("empty", None, 2.0), ("hot", float("nan"), 5.0)]
        df = spark.createDataFrame(rows, "g string, v double, w double")
        got = {q.g: q for q in quantiles.summary(df, ["g"], "v", "w", {"p10": 0.1, "median": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}).collect()}
        assert set(got) == set(v)
        for k, x in v.items():
            assert [got[k].p10, got[k].median, got[k].p90, got[k].least, got[k].most] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.9, 0, 1])))
            assert got[k].weighted_median == pytest.approx(weighted_median(x, w[k]))
        (whole,) = quantiles.exact_quantiles(df, [], "v", {"q": 0.37}).collect()
        assert whole.q == pytest.approx(np.quantile(np.concatenate(list(v.values())), 0.37))
        cells = quantiles._cells(df, ["g"], "v", None)
        assert cells.filter("g = 'hot'").select("_bucket").distinct().count() > 5
        assert quantiles.exact_quantiles(df.filter("w > 100"), ["g"], "v", {"q": 0.5}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
