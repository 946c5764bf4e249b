"""The registry of queries: each plan module lists its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis, daily, feeds, news, streams, technical

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (technical, news, feeds, daily, streams, analysis)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
