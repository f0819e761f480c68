"""The registered queries over the reference's operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import coverage, further, records, stats, texts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**records.QUERIES, **stats.QUERIES, **texts.QUERIES, **coverage.QUERIES, **further.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**records.SQL, **stats.SQL, **texts.SQL, **coverage.SQL, **further.SQL}
