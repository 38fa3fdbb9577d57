"""All queries over the test tables by name, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaver.plans import book, crowd, library, live, whole

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Every query by its name."""
    return {**crowd.QUERIES, **book.QUERIES, **library.QUERIES, **live.QUERIES, **whole.QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL by the name of its query; queries that SQL can't express have none."""
    return {**crowd.ORACLES, **book.ORACLES, **library.ORACLES, **live.ORACLES, **whole.ORACLES}
