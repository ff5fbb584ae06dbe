"""Where the modules of queries enter each query beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    def add(f: Callable[[Views], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add
