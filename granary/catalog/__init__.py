"""Registered queries over the given tables, each with its DuckDB twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from granary.catalog.views import Star, with_views

_QUERIES: dict[str, Callable[[Star], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

_GROUPS = (
    "tables",
    "cleaning",
    "joins",
    "aggregates",
    "windows",
    "scalars",
    "forecasting",
    "operations",
    "experiments",
    "replenishment",
    "explanation",
    "streams",
    "extensions",
)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; `sql` may use the named views as if they were tables."""

    def keep(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = with_views(views, sql)
        return build

    return keep


def _load() -> None:
    for group in _GROUPS:
        import_module(f"granary.catalog.{group}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build: Callable[[Star], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Star(spark, folder))

    return {name: bind(build) for name, build in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
