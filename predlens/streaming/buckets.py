"""Tumbling time buckets over batch or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(
    df: DataFrame, time: str, *aggregates, width: str = "1 day", late: str | None = None
) -> DataFrame:
    """Aggregate into buckets of ``width``; one row per bucket with its start.

    Times without zone stay so. On a stream, ``late`` is how long a bucket stays open for late
    rows; its watermark needs a time with zone.
    """
    plain = isinstance(df.schema[time].dataType, T.TimestampNTZType) and late is None
    timed = df.withColumn("_time", F.col(time) if plain else F.col(time).cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark("_time", late)
    bucket = F.window("_time", width)
    return (
        timed.groupBy(bucket.alias("_bucket"))
        .agg(*aggregates)
        .withColumn("bucket_start", F.col("_bucket.start"))
        .drop("_bucket")
    )
