"""Least squares as DuckDB SQL, for the oracles: moments as lists of lists and Gauss-Jordan steps as a recursive table."""

from __future__ import annotations

RIDGE = "1e-8"


def moments(name: str, source: str, key: str, xs: list[str], w: str) -> str:
    """CTEs that end in ``name``(key, m): the matrix of sums of w * xi * xj over (1, *xs) by ``key``."""
    x = ", ".join(["1.0", *[f"CAST({c} AS DOUBLE)" for c in xs]])
    k = len(xs) + 1
    return f"""{name}_x AS (SELECT {key} AS key, CAST({w} AS DOUBLE) AS w, [{x}] AS x FROM {source}),
{name}_s AS (SELECT key, i, j, sum(w * x[i] * x[j]) AS s FROM {name}_x, range(1, {k + 1}) a(i), range(1, {k + 1}) b(j) GROUP BY key, i, j),
{name} AS (SELECT key, list(r ORDER BY i) AS m FROM (SELECT key, i, list(s ORDER BY j) AS r FROM {name}_s GROUP BY key, i) GROUP BY key)"""


def part(m: str, rows: list[int], columns: list[int]) -> str:
    """The rows and columns (from 1) of a matrix."""
    return f"list_transform({rows}, lambda i: list_transform({columns}, lambda j: {m}[i][j]))"


def solved(name: str, source: str, system: str, ridge: bool = True) -> str:
    """CTEs that end in ``name``(key, b): the solution of the augmented ``system`` of each row; ridge on all but the constant."""
    m = f"list_transform({system}, lambda r, i: list_transform(r, lambda v, j: v + CASE WHEN i = j AND i > 1 THEN {RIDGE} ELSE 0 END))" if ridge else system
    step = "list_transform(m, lambda r, j: CASE WHEN j = i THEN list_transform(r, lambda v: v / r[i]) ELSE list_transform(list_zip(r, m[i]), lambda z: z[1] - r[i] / m[i][i] * z[2]) END)"
    return f"""{name}_r AS (SELECT key, 1 AS i, {m} AS m FROM {source} UNION ALL SELECT key, i + 1, {step} FROM {name}_r WHERE i <= len(m)),
{name} AS (SELECT key, list_transform(m, lambda r: r[len(r)]) AS b FROM {name}_r WHERE i = len(m) + 1)"""


def dot(b: str, xs: list[str]) -> str:
    """b[1] + b[2] * x1 + ..."""
    return " + ".join([f"{b}[1]", *[f"{b}[{i + 2}] * {x}" for i, x in enumerate(xs)]])


def two_way(name: str, source: str, keys: list[str], columns: list[str], unit: str, period: str, rounds: int = 300) -> str:
    """CTEs that end in ``name``: the columns after ``rounds`` of alternating projections on ``unit`` and ``period``."""
    by = ", ".join(keys)
    first = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {unit}) AS {c}" for c in columns)
    second = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {period}) AS {c}" for c in columns)
    return f"""{name}_r AS (SELECT 0 AS i, {by}, {", ".join(columns)} FROM {source}
  UNION ALL SELECT i + 1, {by}, {second} FROM (SELECT i, {by}, {first} FROM {name}_r WHERE i < {rounds})),
{name} AS (SELECT {by}, {", ".join(columns)} FROM {name}_r WHERE i = {rounds})"""
