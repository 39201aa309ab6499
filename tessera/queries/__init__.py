"""Registered queries by operator family: (spark, sf_dir) -> DataFrame, each with DuckDB SQL."""

from __future__ import annotations

from . import chains, demand, details, identification, models, overlays, panels, reports, simulations, sinks, sources_q

_MODULES = (panels, sources_q, models, chains, simulations, reports, overlays, identification, demand, sinks, details)


def flagship(spark, sf_dir):
    return panels.flagship(spark, sf_dir)


def _registered():
    """Name to (query, SQL) of all modules; a name given twice is an error."""
    found = {}
    for m in _MODULES:
        for name, pair in m.REGISTERED.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = pair
    return found


def queries():
    return {name: f for name, (f, _) in _registered().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _registered().items() if sql}
