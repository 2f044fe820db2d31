"""Queries: operators applied to tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tessera.plans import deciding, graph, more, reports, scalars, search, stream

MODULES = (search, graph, reports, scalars, stream, more, deciding)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
