"""Named queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("rollup_queries", "relation_queries", "text_queries", "scoring_queries", "entity_queries", "merge_queries", "stream_queries", "product_queries", "people_queries", "list_queries", "claim_queries", "eda_queries", "source_queries", "record_queries")

#: Clocks of the queries; no operator reads the wall clock.
ORDERS_AS_OF = "2000-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"ledgerlark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
