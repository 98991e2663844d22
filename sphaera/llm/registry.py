"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    decontaminate,
    exact_dedup,
    filter_audit,
    html_extract,
    importance,
    license_scan,
    line_dedup,
    near_dedup,
    piece_codec,
    simhash,
    suffix_dedup,
    toxicity,
)

MODULES = (
    line_dedup,
    license_scan,
    toxicity,
    html_extract,
    exact_dedup,
    near_dedup,
    decontaminate,
    piece_codec,
    importance,
    suffix_dedup,
    filter_audit,
    simhash,
)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
