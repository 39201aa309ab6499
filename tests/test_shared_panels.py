"""Queries that use a panel several times compute it once: how often the plans of a query, staged ones included, scan lineitem."""

import pytest

from tessera import queries
from tessera.sources import tables


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and "/lineitem.parquet" in line for line in plan.splitlines())


@pytest.mark.parametrize(
    ("name", "most"),
    [("local_scenario", 2), ("supply_iv", 2), ("scenario_diagnostics", 1), ("dual_shift_headline", 1), ("fallback_summary", 2), ("pipeline_diagnostics", 2), ("first_component", 1)],
)
def test_a_panel_is_computed_once(name, most, spark, sf_dir, monkeypatch):
    seen, staged = [], tables.staged

    def counted(df):
        seen.append(_scans(df))
        return staged(df)

    monkeypatch.setattr(tables, "staged", counted)
    out = queries.queries()[name](spark, sf_dir)
    assert sum(seen) + _scans(out) <= most
