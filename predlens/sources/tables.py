"""Readers: parquet, headerless CSV, JDBC tables and SQL results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the MySQL/MariaDB driver option that reads zero dates as NULL.
ZERO_DATES_AS_NULL = "zeroDateTimeBehavior=CONVERT_TO_NULL"


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named_csv(
    spark: SparkSession, path: str, columns: Mapping[str, T.DataType], line: str | None = None
) -> DataFrame:
    """A CSV file without header, its columns named and typed here; blank lines are skipped.

    ``line`` names an extra column that grows with the rows' place in the files: file,
    start of the block, then the row's number within the block.
    """
    schema = T.StructType([T.StructField(name, kind) for name, kind in columns.items()])
    rows = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    if line is None:
        return rows
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select("*", place.alias(line))


@dataclass(frozen=True)
class Slices:
    """How a JDBC scan is split: ``count`` ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    count: int


def jdbc_options(
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    driver: str | None = None,
    slices: Slices | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options of a JDBC scan of one table or of one query's result.

    Credentials come in by ``properties`` and are never part of the code. Without
    ``slices`` a single task reads everything, so large tables should be given some.
    Spark refuses to split a ``query``; it is then wrapped as a derived table.
    """
    if (table is None) == (query is None):
        raise ValueError("name either a table or a query")
    options = dict(properties or {})
    options["url"] = zero_dates_as_null(url)
    if driver is not None:
        options["driver"] = driver
    if table is not None:
        options["dbtable"] = table
    elif slices is not None:
        options["dbtable"] = f"({query}) sliced"
    else:
        options["query"] = query
    if slices is not None:
        options["partitionColumn"] = slices.column
        options["lowerBound"] = str(slices.lower)
        options["upperBound"] = str(slices.upper)
        options["numPartitions"] = str(slices.count)
    return options


def jdbc_frame(spark: SparkSession, url: str, **how) -> DataFrame:
    """Lazy JDBC scan; see :func:`jdbc_options`. Filters and columns are pushed down."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **how)).load()


def zero_dates_as_null(url: str) -> str:
    """Add the zero-date option to MySQL and MariaDB addresses that lack it."""
    if not url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) or "zeroDateTimeBehavior" in url:
        return url
    return f"{url}{'&' if '?' in url else '?'}{ZERO_DATES_AS_NULL}"


def sql_frame(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Result of a SQL query; ``views`` names the frames it reads."""
    for name, frame in (views or {}).items():
        expose(frame, name)
    return spark.sql(query)


def expose(df: DataFrame, name: str) -> DataFrame:
    """Make a frame readable by name in SQL."""
    df.createOrReplaceTempView(name)
    return df
