"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_models, queries_pairs, queries_text

MODULES = (queries_models, queries_pairs, queries_text)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
