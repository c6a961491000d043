"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _loaded() -> None:
    from . import change_queries, full_queries, graph_queries, log_queries, order_queries, report_queries, space_queries, typed_queries, upkeep_queries, value_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_sql)
