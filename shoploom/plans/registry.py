"""The queries over the service-desk tables, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from shoploom.sources.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("filters", "tickets", "orders", "contracts", "inbox", "mutations", "scalars", "streams")


def query(sql: str | None = None):
    """Registers a function of Tables under its own name, with the SQL that gives the same rows."""

    def register(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in MODULES:
        import_module(f"shoploom.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
