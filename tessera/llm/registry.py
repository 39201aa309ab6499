"""The operators' queries and their SQL."""

from __future__ import annotations

from . import (
    centroid_clustering,
    decontamination,
    html_extraction,
    line_dedup,
    lm_scoring,
    ngram_join,
    packing,
    pii,
    quality_rules,
    sharding,
    spelling_variants,
    substring_dedup,
    token_records,
)

_MODULES = (pii, lm_scoring, line_dedup, decontamination, sharding, ngram_join, packing, quality_rules, html_extraction, substring_dedup, spelling_variants, centroid_clustering, token_records)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
