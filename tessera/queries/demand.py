"""Demand fits: two stages with errors and gates, headline samples, held-out errors by state and by year, specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import moments
from tessera.sources import tables

from . import base, linear_sql, models

_COLUMNS = ["outside", "price", "hours", "control"]
MODES = ["broad", "core", "core_low_impute"]
HEADLINE_ORDER = ["core_low_impute", "core"]


def _modes(rows: DataFrame) -> DataFrame:
    """Each row once for each sample it belongs to."""
    core = F.col("year").between(base.CORE_FIRST, base.CORE_LAST) & (F.col("year") != base.SENSITIVITY)
    modes = F.array_compact(F.array(F.lit("broad"), F.when(core, "core"), F.when(core & (F.col("imputed_share") <= 0.25), "core_low_impute")))
    return rows.withColumn("mode", F.explode(modes))


def _shown(df: DataFrame) -> DataFrame:
    """Rounded for comparison; an error with a weak instrument keeps fewer digits of the inverse."""
    return base.rounded(df.withColumn("price_se", F.round("price_se", 1)), 4)


def demand_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage fits with coefficient errors of three samples from one moments scan, their support, the gates, and the sample picked by order."""
    rows = tables.staged(_modes(models.demand_rows(spark, sf_dir)).select("mode", "geo1", "year", "rw", *_COLUMNS))
    fits = moments.two_stage_fits(moments.moment_rows(rows, _COLUMNS, F.col("rw"), ["mode"]), [("mode", "string")])
    facts = rows.groupBy("mode").agg(F.count_distinct("geo1").alias("n_groups"), F.count_distinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return _shown(moments.with_headline(fits.join(facts, "mode"), "mode", HEADLINE_ORDER))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: leave-one-state-out and leave-one-year-out errors of every sample, from one table of moments by fold."""
    rows = _modes(models.demand_rows(spark, sf_dir))
    kinds = F.explode(F.array(F.struct(F.lit("state").alias("kind"), F.col("geo1").alias("fold")), F.struct(F.lit("year").alias("kind"), F.col("year").alias("fold"))))
    rows = rows.select("mode", kinds.alias("k"), "rw", *_COLUMNS).select("mode", "k.*", "rw", *_COLUMNS)
    folds = tables.staged(moments.moment_rows(rows, _COLUMNS, F.col("rw"), ["mode", "kind", "fold"]))
    return base.rounded(moments.leave_one_out(folds, [("mode", "string"), ("kind", "string")], "fold"), 4)


SPECIFICATIONS = {"none": [], "control": ["control"], "wage": ["wage"], "wage_and_control": ["wage", "control"]}


def specification_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage fits under four control sets, each on its own complete rows, and the preferred one (admissible sign first, then strength)."""
    rows = tables.staged(models.demand_rows(spark, sf_dir).select("rw", "wage", *_COLUMNS))
    fits = None
    for name, controls in SPECIFICATIONS.items():
        own = moments.complete(rows, ["outside", "price", "hours", *controls], "price").withColumn("profile", F.lit(name))
        fit = moments.two_stage_fits(moments.moment_rows(own, ["outside", "price", "hours", *controls], F.col("rw"), ["profile"]), [("profile", "string")])
        fits = fit if fits is None else fits.unionByName(fit)
    fits = tables.staged(fits)
    best = F.max(F.struct((F.col("elasticity_at_mean") <= 0).alias("admissible"), "first_stage_f", "profile")).alias("best")
    best = fits.agg(best).select(F.col("best.profile").alias("_best"))
    return _shown(fits.crossJoin(F.broadcast(best)).withColumn("preferred", F.col("profile") == F.col("_best")).drop("_best"))


def _inverse_second(name: str, source: str, m: str, k: int) -> str:
    """CTE ``name``(key, b): b[2] is the second diagonal entry of the inverse of the first k rows and columns."""
    return linear_sql.solved(name, source, f"list_transform({m}[1:{k}], lambda r, i: list_concat(r[1:{k}], [CASE WHEN i = 2 THEN 1.0 ELSE 0.0 END]))", ridge=False)


def two_stage_sql(p: str, source: str, key: str, controls: list[str], full: bool = True) -> str:
    """CTEs that end in ``p``_fit: both stages by rows, one after the other, with z = outside, p = price, y = hours, w = rw."""
    k = 2 + len(controls)
    few = [1, *range(3, k + 1)]
    parts = [
        linear_sql.moments(f"{p}m1", source, key, ["outside", *controls, "price"], "rw"),
        linear_sql.solved(f"{p}b1", f"{p}m1", f"m[1:{k}]"),
        linear_sql.solved(f"{p}b0", f"{p}m1", linear_sql.part("m", few, [*few, k + 1])),
        f"{p}r1 AS (SELECT s.*, {linear_sql.dot('b1.b', ['outside', *controls])} AS ph, {linear_sql.dot('b0.b', controls)} AS p0 FROM {source} s JOIN {p}b1 b1 ON b1.key = s.{key} JOIN {p}b0 b0 ON b0.key = s.{key})",
        linear_sql.moments(f"{p}m2", f"{p}r1", key, ["ph", *controls, "hours"], "rw"),
        linear_sql.solved(f"{p}b2", f"{p}m2", f"m[1:{k}]"),
    ]
    if full:
        parts += [
            linear_sql.moments(f"{p}m3", source, key, ["price", *controls, "hours"], "rw"),
            linear_sql.solved(f"{p}b3", f"{p}m3", f"m[1:{k}]"),
            _inverse_second(f"{p}i1", f"{p}m1", "m", k),
            _inverse_second(f"{p}i2", f"{p}m2", "m", k),
            f"""{p}r2 AS (SELECT r.*, b1.b[2] AS c1, b2.b[2] AS c2, b3.b[2] AS c3, i1.b[2] AS v1, i2.b[2] AS v2, {linear_sql.dot('b2.b', ['ph', *controls])} AS fit, {linear_sql.dot('b2.b', ['price', *controls])} AS actual,
  {linear_sql.dot('b3.b', ['price', *controls])} AS reduced FROM {p}r1 r JOIN {p}b1 b1 ON b1.key = r.{key} JOIN {p}b2 b2 ON b2.key = r.{key} JOIN {p}b3 b3 ON b3.key = r.{key} JOIN {p}i1 i1 ON i1.key = r.{key} JOIN {p}i2 i2 ON i2.key = r.{key})""",
            f"""{p}s AS (SELECT {key}, count(*) AS n_obs, any_value(c1) AS c1, any_value(c2) AS c2, any_value(c3) AS c3, any_value(v1) AS v1, any_value(v2) AS v2, sum(rw) AS w, sum(rw * price) / sum(rw) AS mp, sum(rw * hours) / sum(rw) AS my,
  sum(rw * (price - ph) ** 2) AS e1, sum(rw * (price - p0) ** 2) AS e0, sum(rw * (hours - actual) ** 2) AS e2, sum(rw * (hours - reduced) ** 2) AS e3, sum(rw * fit) / sum(rw) AS avg_fitted FROM {p}r2 GROUP BY {key}),
{p}v AS (SELECT {key}, sum(rw * (price - mp) ** 2) AS vp, sum(rw * (hours - my) ** 2) AS vy FROM {source} JOIN {p}s USING ({key}) GROUP BY {key})""",
            f"""{p}_fit AS (SELECT s.{key}, n_obs, c1 AS first_stage_coefficient, sqrt(e1 / (n_obs - {k}) * v1) AS first_stage_se, c1 ** 2 / (e1 / (n_obs - {k}) * v1) AS first_stage_f, 1 - e1 / vp AS first_stage_r2, 1 - e1 / e0 AS first_stage_partial_r2,
  c2 AS price_coefficient, sqrt(e2 / (n_obs - {k}) * v2) AS price_se, c3 AS reduced_form_price_coefficient, 1 - e3 / vy AS reduced_form_r2, c2 * mp / my AS elasticity_at_mean, avg_fitted,
  c2 <= 0 AND c2 * mp / my <= 0 AS admissible, c3 <= 0 AS sign_consistent FROM {p}s s JOIN {p}v v ON v.{key} = s.{key})""",
        ]
    return ",\n".join(parts)


_NUMBERS = [c.split(" ")[0] for c in moments.FIT.split(", ") if c.endswith("double")]
_SHOWN = ", ".join(f"round({c}, {1 if c == 'price_se' else 4}) AS {c}" for c in _NUMBERS)
_MODES_SQL = f"""{models.DEMAND}, mo AS (SELECT *, unnest(list_filter(['broad', CASE WHEN core THEN 'core' END, CASE WHEN core AND imputed_share <= 0.25 THEN 'core_low_impute' END], lambda x: x IS NOT NULL)) AS mode
  FROM (SELECT *, year BETWEEN {base.CORE_FIRST} AND {base.CORE_LAST} AND year <> {base.SENSITIVITY} AS core FROM dem))"""
PROFILES = f"""WITH RECURSIVE {_MODES_SQL},
{two_stage_sql("q", "mo", "mode", ["control"])},
f AS (SELECT mode, count(DISTINCT geo1) AS n_groups, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year FROM mo GROUP BY mode),
j AS (SELECT *, list_position(['core_low_impute', 'core'], mode) AS place FROM q_fit JOIN f USING (mode)),
g AS (SELECT *, place IS NOT NULL AND admissible AND sign_consistent AND n_obs >= 100 AND n_groups >= 15 AND n_years >= 6 AND first_stage_f >= 10 AS ok FROM j),
b AS (SELECT min(place) FILTER (ok) AS best FROM g)
SELECT mode, n_obs, {_SHOWN}, admissible, sign_consistent, n_groups, n_years, first_year, last_year, ok AS headline_eligible, CAST(coalesce(place, 3) AS INT) AS headline_rank, coalesce(ok AND place = best, false) AS selected,
  CASE WHEN coalesce(ok AND place = best, false) THEN 'first_to_pass' WHEN ok THEN 'an_earlier_sample_passes' WHEN place IS NULL THEN 'not_a_headline_sample' ELSE 'below_the_gates' END AS reason FROM g, b"""

HELD_OUT = f"""WITH RECURSIVE {_MODES_SQL},
kf AS (SELECT mode, unnest(['state', 'year']) AS kind, unnest([geo1, year]) AS fold, rw, outside, price, hours, control FROM mo),
fo AS (SELECT mode, kind, fold, count(*) AS n FROM kf GROUP BY ALL),
tr AS (SELECT k.mode || '|' || k.kind || '|' || f.fold AS id, k.* EXCLUDE (fold), f.fold FROM fo f JOIN kf k ON k.mode = f.mode AND k.kind = f.kind AND k.fold <> f.fold),
{two_stage_sql("h", "tr", "id", ["control"], full=False)},
te AS (SELECT k.*, {linear_sql.dot("b1.b", ["outside", "control"])} AS ph, b2.b AS b2 FROM kf k JOIN hb1 b1 ON b1.key = k.mode || '|' || k.kind || '|' || k.fold JOIN hb2 b2 ON b2.key = b1.key),
pr AS (SELECT *, {linear_sql.dot("b2", ["ph", "control"])} AS fit FROM te),
el AS (SELECT mode, kind, fold, any_value(b2[2]) * (sum(rw * price) / sum(rw * hours)) AS e FROM pr GROUP BY mode, kind, fold)
SELECT mode, kind, count(DISTINCT fold) AS groups, round(sqrt(sum(rw * (hours - fit) ** 2) / sum(rw)), 4) AS rmse, round(1 - sum(rw * (hours - fit) ** 2) / (sum(rw * hours * hours) - sum(rw * hours) ** 2 / sum(rw)), 4) AS r2,
  round(any_value(lo), 4) AS elasticity_min, round(any_value(hi), 4) AS elasticity_max FROM pr JOIN (SELECT mode, kind, min(e) AS lo, max(e) AS hi FROM el GROUP BY ALL) USING (mode, kind) GROUP BY mode, kind"""

SWEEP = f"""WITH RECURSIVE {models.DEMAND}, {", ".join(f"sp_{n} AS (SELECT *, '{n}' AS profile FROM dem{' WHERE ' + ' AND '.join(f'{c} IS NOT NULL' for c in controls) if controls else ''})" for n, controls in SPECIFICATIONS.items())},
{", ".join(two_stage_sql(f"z{i}", f"sp_{n}", "profile", controls) for i, (n, controls) in enumerate(SPECIFICATIONS.items()))},
a AS ({" UNION ALL ".join(f"SELECT * FROM z{i}_fit" for i in range(len(SPECIFICATIONS)))})
SELECT profile, n_obs, {_SHOWN}, admissible, sign_consistent, profile = (SELECT profile FROM a ORDER BY elasticity_at_mean <= 0 DESC, first_stage_f DESC, profile DESC LIMIT 1) AS preferred FROM a"""

REGISTERED = {"demand_profiles": (demand_profiles, PROFILES), "held_out_demand": (held_out, HELD_OUT), "specification_sweep": (specification_sweep, SWEEP)}
