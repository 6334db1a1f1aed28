"""All queries of the library and their SQL, by operator name.

A module registers a query with ``@query(name, sql)``; the function takes ``Tables``.  The SQL is
DuckDB's and may name the views of ``warraq.bindings``: those it uses are put before it.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from warraq.bindings import Tables, with_views

#: Modules that register queries.
MODULES = [
    "functions.queries", "operators.rules", "operators.segment", "operators.chains", "operators.joins", "operators.analytics",
    "operators.search", "operators.graph", "operators.maintenance", "operators.datasets", "sources.queries", "plans.workloads",
]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        _queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _oracles[name] = with_views(sql)
        return f

    return register


def _load():
    for name in MODULES:
        import_module(f"warraq.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
