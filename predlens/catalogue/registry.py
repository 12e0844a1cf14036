"""Names, callables and check SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from predlens.functions.scalars import half_up
from predlens.sources.tables import parquet_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows where there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECK_SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return parquet_table(spark, folder, name)


def fixed(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round columns for comparison: two engines add doubles in different orders."""
    return df.withColumns({name: half_up(df[name], digits) for name in names})


def sql_fixed(expression: str, digits: int) -> str:
    """The same rounding as :func:`fixed` in the check SQL."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def sql_even(expression: str, digits: int) -> str:
    """Rounding of halves to the even digit in the check SQL."""
    return f"ROUND_EVEN(ROUND({expression}, 9), {digits})"
