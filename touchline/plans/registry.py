"""Every query next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.plans.fixtures import Fixtures, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, like: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``; the SQL of the query ``like`` checks it too."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check:
            CHECKS[name] = check_sql(check)
        elif like:
            CHECKS[name] = CHECKS[like]
        return fn

    return register
