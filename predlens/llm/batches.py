"""Arrow batches small enough for rows that carry whole texts, sets or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 512  # of a hundred kB each these are 50 MB; Spark's own 10,000 would be a gigabyte


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session sending at most ``ROWS`` rows at once to Python workers.

    The setting belongs to the session, and a smaller one that is already there stays.
    """
    held = df.sparkSession.conf.get(SETTING, None)
    if held is None or not 0 < int(held) <= ROWS:
        df.sparkSession.conf.set(SETTING, str(ROWS))
    return df
