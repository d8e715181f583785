"""Every named query of the library and the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "hybrid_search"
_MODULES = ("text", "search", "evaluation", "market", "conversations", "knowledge", "understanding", "ingest", "upkeep", "news")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(run: Query) -> Query:
        _queries[run.__name__] = run
        if sql:
            _sql[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
