"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import codes, fingerprint, html_text, knn, mixing, near_join, packing, quality, secrets, simhash, suffix_tree, trie, urlfilter

_MODULES = (codes, fingerprint, html_text, knn, mixing, near_join, packing, quality, secrets, simhash, suffix_tree, trie, urlfilter)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the modules here, by name."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
