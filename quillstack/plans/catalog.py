"""Named queries over the test tables and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import reports, retrieval, runs, structure

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [structure, retrieval, reports, runs]


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
