"""The queries of the core with their SQL; each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrel.session import table
from spindrel.sources.csv_rows import parted_rows, rejected_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("p4_found")
def p4_found(spark, d):
    return rejected_rows(table(spark, d, "raw_rows"))


@query("p4_valid_rows")
def p4_valid_rows(spark, d):
    return parted_rows(table(spark, d, "raw_rows")).where("reason is null").drop("reason")
