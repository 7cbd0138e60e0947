"""All registered queries of the core: name -> (callable, SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Add the function under its own name; sql is the statement with the same result, where SQL can express it."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in ("journal_queries", "search_queries", "graph_queries", "table_queries", "document_queries", "ingest_queries", "fold_queries", "report_queries"):
        import_module(f"quillspark.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
