"""All registered queries of the reference's operators, and the SQL that checks them."""

from __future__ import annotations

from . import queries_aggregates, queries_citations, queries_documents, queries_imports, queries_ranking, queries_repairs, queries_rules, queries_text

_MODULES = (queries_rules, queries_aggregates, queries_ranking, queries_text, queries_documents, queries_citations, queries_imports, queries_repairs)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
