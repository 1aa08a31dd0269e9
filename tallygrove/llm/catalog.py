"""All queries of this subpackage and their oracles."""

from __future__ import annotations

from tallygrove.llm import queries_quantiles, queries_records, queries_text

MODULES = (queries_records, queries_quantiles, queries_text)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
