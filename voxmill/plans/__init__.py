"""Named queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmill.plans import cases, fields, geometry, records, scoring

_MODULES = (cases, fields, geometry, records, scoring)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the modules here, by name."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
