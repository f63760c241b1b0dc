"""The registered queries: name, function of (spark, sf_dir), and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search_queries", "quality_queries", "more_queries", "source_queries", "ordered_queries")
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name."""

    def put(f):
        _QUERIES[name] = (f, sql)
        return f

    return put


def sql_of(name: str) -> str | None:
    """The SQL of a query that is registered already."""
    return _QUERIES[name][1]


def _load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
