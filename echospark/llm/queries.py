"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import decontamination, language, licenses, line_dedup, near_dedup, packing, periodic, quality, simhash, toxicity, url_filter, vector_codes, warc

MODULES = (toxicity, url_filter, line_dedup, decontamination, packing, quality, warc, near_dedup, licenses, language, periodic, simhash, vector_codes)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
