"""All queries outside the llm subpackage and their oracles."""

from __future__ import annotations

from tallygrove.plans import domain_linkage, domain_models, domain_more, domain_qc, domain_results, io, relational, screening, statistics

MODULES: tuple = (relational, statistics, domain_qc, domain_linkage, domain_models, domain_results, domain_more, io, screening)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
