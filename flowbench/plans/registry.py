"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from flowbench.plans import evaluation, tables

MODULES = (evaluation, tables)


def queries() -> dict:
    """Name -> query(spark, sf_dir)."""
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Name -> DuckDB SQL."""
    return {name: sql for m in MODULES for name, sql in m.SQLS.items()}
