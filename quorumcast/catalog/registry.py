"""Collects the registered queries and their SQL from the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumcast.shipping import ship
from quorumcast.sources.event_bridge import EventTables

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its name, with its SQL if any."""

    def wrap(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(EventTables(spark, folder))

        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = run
        if sql is not None:
            _SQL[key] = sql
        return fn

    return wrap


def _load() -> None:
    from quorumcast.catalog import (  # noqa: F401
        ensemble_queries,
        feature_queries,
        gate_queries,
        grid_queries,
        kpi_queries,
        plan_queries,
        score_queries,
        source_queries,
    )


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
