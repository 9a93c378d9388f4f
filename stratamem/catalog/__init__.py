"""Every query of the package with its SQL counterpart."""

from __future__ import annotations

from stratamem.catalog import documents, lexical, lifecycle, maintained, ranking, records, search, streams

MODULES = (search, lexical, ranking, lifecycle, records, documents, streams, maintained)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
