"""Named queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carefold.plans.domain import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its check over the given views."""
    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_views(views, sql)
        return fn
    return add


def _load() -> None:
    from carefold.plans import (queries_columns, queries_domain, queries_models,  # noqa: F401
                                queries_relational, queries_statistics, queries_jobs)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, folder, f=f: f(Tables(spark, folder))) for n, f in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
