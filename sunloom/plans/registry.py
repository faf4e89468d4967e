"""All queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sunloom.plans import analyses, problems, relational

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**problems.QUERIES, **relational.QUERIES, **analyses.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational.SQL, **problems.SQL, **analyses.SQL}
