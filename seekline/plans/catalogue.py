"""All registered queries of the core, by name, and their SQL."""

from __future__ import annotations

from seekline.plans import core_queries, orphan_queries

MODULES = [core_queries, orphan_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
