"""Regressions from moment sums.

Every estimator scans the data once for the sums of w*xi*xj over (1, z, p, y,
controls); coefficients, errors, R2, F and held-out errors are functions of
those sums. Models, folds, thresholds and draws are rows of one moments table;
only the k-by-k solves run in Python, on aggregated rows, inside tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-8
LEAST_TRAIN, LEAST_FOLDS = 5, 3


def regression_weight(weight) -> Column:
    """M5: the survey weight where positive, else 1."""
    w = F.col(weight)
    return F.when(w > 0, w).otherwise(F.lit(1.0))


def complete(df: DataFrame, columns: list[str], price: str) -> DataFrame:
    """M4: complete cases with a positive price."""
    condition = F.col(price) > 0
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return df.filter(condition)


def moment_rows(df: DataFrame, columns: list[str], weight: Column, by: list[str]) -> DataFrame:
    """A19 by group: ``m`` (upper triangle of sums, a constant first), and n."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col("_w") * names[i] * names[j]) for i, j in pairs]
    return df.withColumn("_w", weight).groupBy(*by).agg(F.array(*sums).alias("m"), F.count("*").alias("n"))


def square(m) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    m = np.asarray(m, float)
    k = int((np.sqrt(8 * len(m) + 1) - 1) / 2)
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = m
    return out + np.triu(out, 1).T


def centred(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means, and the moments about them: the constant is eliminated first, as no penalty concerns it."""
    means = a[0] / a[0, 0] if a[0, 0] else np.zeros(len(a))
    return means, a - np.outer(a[0], means)


#: The least share of a column's size, or of its variance, that is told from the rounding of sums over data (of many equal terms, which round to one side) and of products of them.
ROUNDING, REPEATED, EXACT = 1e-12, 1e-9, 1e-14


def ridge(c: np.ndarray, right: np.ndarray, size: np.ndarray | None = None, least: float = ROUNDING, penalty: float = RIDGE) -> np.ndarray:
    """M1 on centred moments: a direction in which the columns do not vary gets 0, as in exact arithmetic only the penalty would decide it.

    Columns are brought to one scale first. ``size``: the columns' raw sums of squares, which tell a constant column from its rounding.
    """
    out, own = np.zeros(len(c)), np.diag(c)
    vary = np.flatnonzero(own > (least * size if size is not None else 0))
    if not len(vary):
        return out
    c, scale = c[np.ix_(vary, vary)], np.sqrt(own[vary])
    value, vector = np.linalg.eigh(c / np.outer(scale, scale))
    still = vector[:, value <= least] / scale[:, None]
    basis = np.linalg.qr(still, mode="complete")[0][:, still.shape[1] :] if still.shape[1] else np.eye(len(vary))
    system = basis.T @ c @ basis + penalty * np.eye(basis.shape[1])
    d = np.sqrt(np.diag(system))
    out[vary] = basis @ (np.linalg.solve(system / np.outer(d, d), basis.T @ right[vary] / d) / d)
    return out


def fitted(a: np.ndarray, x: list[int], y: int, around: np.ndarray | float = 0.0, least: float = ROUNDING) -> np.ndarray:
    """M1: coefficients of y on x (place 0 is the constant, unpenalised); ``around``: what was taken off each column before its moments."""
    means, c = centred(a)
    inner, raw = x[1:], means + around
    b = ridge(c[np.ix_(inner, inner)], c[inner, y], np.diag(c)[inner] + a[0, 0] * raw[inner] ** 2, least)
    return np.array([raw[y] - b @ raw[inner], *b])


def r2(a: np.ndarray, y: int, error: float) -> float | None:
    """M2."""
    total = a[y, y] - a[0, y] ** 2 / a[0, 0]
    return 1 - error / total if total > 0 else None


def two_stage(m, n: int) -> dict[str, float | int | bool | None]:
    """M6, M7, M10 on moments of (1, z, p, y, controls...): both stages, F, partial R2, elasticity, gates."""
    a = square(m)
    k = len(a)
    z, p, y, controls = 1, 2, 3, list(range(4, k))
    means, c = centred(a)
    size, few = np.diag(a), [z, *controls]
    coefficients = lambda x, target: ridge(c[np.ix_(x, x)], c[x, target], size[x])
    left = lambda x, b, target: float(c[target, target] - 2 * b @ c[x, target] + b @ c[np.ix_(x, x)] @ b)
    inverse = lambda m, sizes, least: float(ridge(m, np.eye(len(m))[0], sizes, least, 0.0)[0])
    g = coefficients(few, p)
    e1, e0 = left(few, g, p), left(controls, coefficients(controls, p), p)
    b1 = np.array([means[p] - g @ means[few], *g])
    error = np.sqrt(max(e1 / max(n - len(b1), 1), 0) * inverse(c[np.ix_(few, few)], size[few], ROUNDING))
    # the second stage's regressors are a linear map of (1, z, p, y, controls)
    t = np.zeros((k, 2 + len(controls)))
    t[0, 0] = 1
    t[[0, *few], 1] = b1
    for i, control in enumerate(controls):
        t[control, 2 + i] = 1
    own = t[:, 1:]
    system = own.T @ c @ own
    h = ridge(system, own.T @ c[:, y], None, EXACT)
    b2 = np.array([means[y] - h @ (means @ own), *h])
    reduced = [p, *controls]
    ols = coefficients(reduced, y)
    elasticity = float(h[0] * a[0, p] / a[0, y]) if a[0, y] else None
    f = float(g[0] / error) ** 2 if error > 0 else 0.0
    # the second stage's errors come from residuals at the actual price
    price_error = np.sqrt(max(left(reduced, h, y), 0) / max(n - t.shape[1], 1) * inverse(system, None, EXACT))
    return {
        "n_obs": int(n), "first_stage_coefficient": float(b1[1]), "first_stage_se": float(error), "first_stage_f": f, "first_stage_r2": r2(a, p, e1), "first_stage_partial_r2": 1 - e1 / e0 if e0 > 0 else 0.0,
        "price_coefficient": float(b2[1]), "price_se": float(price_error), "reduced_form_price_coefficient": float(ols[0]), "reduced_form_r2": r2(a, y, left(reduced, ols, y)),
        "elasticity_at_mean": elasticity, "avg_fitted": float(a[0] @ t @ b2 / a[0, 0]),
        "admissible": bool(b2[1] <= 0 and elasticity is not None and elasticity <= 0), "sign_consistent": bool(ols[0] <= 0),
        "_b2": b2, "_t": t, "_means": means,
    }


FIT = ", ".join(
    ["n_obs long"]
    + [f"{c} double" for c in "first_stage_coefficient first_stage_se first_stage_f first_stage_r2 first_stage_partial_r2 price_coefficient price_se reduced_form_price_coefficient reduced_form_r2 elasticity_at_mean avg_fitted".split()]
    + ["admissible boolean", "sign_consistent boolean"]
)


def two_stage_fits(rows: DataFrame, by: list[tuple[str, str]]) -> DataFrame:
    """One fit for each moments row (sample, threshold, profile, draw ...); ``by``: (name, type) of the keys."""
    names = [b for b, _ in by]
    fields = [x.split(" ")[0] for x in FIT.split(", ")]

    def fit(frames):
        for frame in frames:
            out = [{**{b: getattr(r, b) for b in names}, **{k: v for k, v in two_stage(r.m, r.n).items() if k in fields}} for r in frame.itertuples()]
            yield pd.DataFrame(out, columns=[*names, *fields])

    return rows.mapInPandas(fit, ", ".join([f"{b} {t}" for b, t in by] + [FIT]))


def price_surface(df: DataFrame, target: str, features: list[str], weight: Column, year: str) -> DataFrame:
    """M3: the complete rows with ``predicted`` and ``held_out``: weighted least squares without the last year, which is held out.

    With a single year all rows are both. The fit is one row of moments, so the data are read once for it and once to predict.
    """
    rows = df.filter(" and ".join(f"{c} is not null" for c in (target, *features)))
    ends = rows.agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    rows = rows.crossJoin(F.broadcast(ends))
    one = F.col("_first") == F.col("_last")
    rows = rows.withColumns({"held_out": F.col(year) == F.col("_last"), "trained_on": one | (F.col(year) < F.col("_last"))}).drop("_first", "_last")
    k = len(features)

    def solve(frames):
        for frame in frames:
            yield pd.DataFrame({"_b": [fitted(square(m), list(range(k + 1)), k + 1).tolist() for m in frame["m"] if m[0] is not None]})

    fit = moment_rows(rows.filter("trained_on"), [*features, target], weight, []).select("m").mapInPandas(solve, "_b array<double>")
    predicted = sum((F.get("_b", F.lit(i + 1)) * F.col(c) for i, c in enumerate(features)), F.get("_b", F.lit(0)))
    return rows.crossJoin(F.broadcast(fit)).withColumn("predicted", predicted)


def surface_quality(df: DataFrame, target: str) -> DataFrame:
    """M2, M3: one row: rows, root mean squared error and R2 of the rows trained on and of those held out."""
    out = [F.count("*").alias("n_obs")]
    for name, side in (("train", "trained_on"), ("test", "held_out")):
        y = F.when(F.col(side), F.col(target))
        error = F.when(F.col(side), (F.col(target) - F.col("predicted")) * (F.col(target) - F.col("predicted")))
        total = F.var_pop(y) * F.count(y)
        out += [F.sqrt(F.avg(error)).alias(f"rmse_{name}"), F.when(total == 0, 1.0).otherwise(1 - F.sum(error) / total).alias(f"r2_{name}")]
    return df.agg(*out)


FOLD = "error double, total double, sum double, squares double, elasticity double, used boolean"


def leave_one_out(folds: DataFrame, by: list[tuple[str, str]], fold: str) -> DataFrame:
    """M9: per group of folds ``by`` (sample, kind of fold ...): held-out errors of two-stage fits, each without one fold.

    ``folds`` (staged) has the moments of each fold: a training set's are all folds' less
    its own, and an error is bilinear in the moments, so the data are scanned once for
    all folds of all kinds. Each fold is a row that is solved by itself; what is pooled
    are five sums. Folds whose training set is too small count as groups only; with
    fewer than ``LEAST_FOLDS`` groups there is no result.
    """
    names = [b for b, _ in by]
    each = folds.select(*names, "n", F.posexplode("m").alias("_at", "_v"))
    whole = each.groupBy(*names, "_at").agg(F.sum("_v").alias("_v"), F.sum("n").alias("_all")).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_m"), F.max("_all").alias("_all"))
    rows = folds.join(whole.select(*names, F.transform("_m", lambda x: x["_v"]).alias("_whole"), "_all"), names)

    def one(m, n, whole, total) -> tuple:
        own, n = np.asarray(m, float), int(total) - int(n)
        if n < LEAST_TRAIN:
            return (None, None, None, None, None, False)
        fit, a = two_stage(np.asarray(whole, float) - own, n), square(own)
        # errors about the training set's means, where the prediction is the mean: large constants do not meet
        move = np.eye(len(a))
        move[1:, 0] = -fit["_means"][1:]
        e = -(fit["_t"][:, 1:] @ fit["_b2"][1:])
        e[0], e[3] = 0, e[3] + 1
        elasticity = float(fit["_b2"][1] * a[0, 2] / a[0, 3]) if a[0, 3] else None
        return (float(e @ move @ a @ move.T @ e), a[0, 0], a[0, 3], a[3, 3], elasticity, True)

    def solve(frames):
        for frame in frames:
            out = [one(*r) for r in zip(frame["m"], frame["n"], frame["_whole"], frame["_all"], strict=True)]
            solved = pd.DataFrame(out, columns=[x.split(" ")[0] for x in FOLD.split(", ")])
            yield pd.concat([frame[names].reset_index(drop=True), solved], axis=1)

    held = rows.select(*names, "m", "n", "_whole", "_all").mapInPandas(solve, ", ".join([f"{b} {t}" for b, t in by] + [FOLD]))
    spread = F.sum("squares") - F.sum("sum") * F.sum("sum") / F.sum("total")
    enough = F.count("*") >= LEAST_FOLDS
    return held.groupBy(*names).agg(
        F.count("*").alias("groups"), F.when(enough, F.sqrt(F.sum("error") / F.sum("total"))).alias("rmse"), F.when(enough & (spread > 0), 1 - F.sum("error") / spread).alias("r2"),
        F.when(enough, F.min("elasticity")).alias("elasticity_min"), F.when(enough, F.max("elasticity")).alias("elasticity_max"),
    )


#: The least rows, states, years and first-stage F of a headline fit.
HEADLINE = {"n_obs": 100, "n_groups": 15, "n_years": 6, "first_stage_f": 10.0}


def passes_headline(gates: dict[str, float] = HEADLINE) -> Column:
    """The gates of a headline fit: support, first stage, and both signs."""
    out = F.col("admissible") & F.col("sign_consistent")
    for c, least in gates.items():
        out = out & (F.col(c) >= least)
    return F.coalesce(out, F.lit(False))


def with_headline(fits: DataFrame, mode: str, order: list[str]) -> DataFrame:
    """``headline_eligible``, ``headline_rank`` (place in ``order``) and which fit is ``selected``: the first in order that passes; a reason."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(mode))
    rows = fits.withColumns({"headline_eligible": passes_headline() & (rank > 0), "headline_rank": F.when(rank > 0, rank).otherwise(len(order) + 1).cast("int")})
    best = rows.filter("headline_eligible").agg(F.min("headline_rank").alias("_best"))
    rows = rows.crossJoin(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("headline_eligible") & (F.col("headline_rank") == F.col("_best")), F.lit(False)))
    reason = F.when(F.col("selected"), "first_to_pass").when(F.col("headline_eligible"), "an_earlier_sample_passes").when(rank == 0, "not_a_headline_sample").otherwise("below_the_gates")
    return rows.withColumn("reason", reason).drop("_best")


def weighted_slope(y: str, x: str, w: Column) -> list[Column]:
    """M1 for one regressor in closed form, as aggregates: n, slope, intercept, weighted R2."""
    yc, xc = F.col(y), F.col(x)
    sw, sx, sy = F.sum(w), F.sum(w * xc), F.sum(w * yc)
    sxx, sxy, syy = F.sum(w * xc * xc) - sx * sx / sw, F.sum(w * xc * yc) - sx * sy / sw, F.sum(w * yc * yc) - sy * sy / sw
    b = F.when(sxx > 0, sxy / sxx)
    return [F.count("*").alias("n"), b.alias("slope"), (sy / sw - b * sx / sw).alias("intercept"), F.when(syy > 0, b * sxy / syy).alias("r2")]


def just_identified(y: str, p: str, z: str, w: Column) -> list[Column]:
    """M6 with one instrument and no controls, as aggregates: the ratio of covariances and the first stage."""
    yc, pc, zc = F.col(y), F.col(p), F.col(z)
    sw, sz, sp, sy = F.sum(w), F.sum(w * zc), F.sum(w * pc), F.sum(w * yc)
    zp, zy = F.sum(w * zc * pc) - sz * sp / sw, F.sum(w * zc * yc) - sz * sy / sw
    zz, pp = F.sum(w * zc * zc) - sz * sz / sw, F.sum(w * pc * pc) - sp * sp / sw
    b1, b2 = zp / zz, zy / zp
    e1 = pp - b1 * zp
    f = b1 * b1 * zz * (F.count("*") - 2) / e1
    return [F.count("*").alias("n"), b1.alias("first_stage"), f.alias("first_stage_f"), b2.alias("price_coefficient"), (b2 * sp / sy).alias("elasticity_at_mean")]


def principal_component(df: DataFrame, columns: list[str], keys: list[str], out: str = "first_component") -> DataFrame:
    """Score on the first component of standardised columns (null: 0; constant: 0), in line with the equal-weight index.

    Moments are sums; the k-by-k eigenvector is found from them on the driver, one row of k*k numbers.
    """
    first = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).first()
    scaled = {}
    for i, c in enumerate(columns):
        s = first[f"s{i}"]
        scaled[f"_z{i}"] = F.coalesce((F.col(c) - first[f"a{i}"]) / s, F.lit(0.0)) if s else F.lit(0.0)
    rows = df.withColumns(scaled)
    k = len(columns)
    if first["n"] < 3 or k < 2 or not any(first[f"s{i}"] for i in range(k)):
        return rows.select(*keys, F.lit(None).cast("double").alias(out))
    sums = rows.agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    a = square([sums[f"c{i}_{j}"] for i in range(k) for j in range(i, k)])
    v = np.linalg.eigh(a)[1][:, -1]
    v = v if (a @ v).sum() >= 0 else -v
    score = sum((F.col(f"_z{i}") * float(v[i]) for i in range(1, k)), F.col("_z0") * float(v[0]))
    return rows.select(*keys, score.alias(out))
