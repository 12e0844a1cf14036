"""Running totals over groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predlens.session import durable


def running_total(df: DataFrame, group: str, order: list[Column], value: str, into: str = "before") -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over the earlier rows of the same ``group``.

    The rows are dealt into ranges of (group, order), so a group that holds most rows is cut
    like any other; a range's total is added to the later ranges of its group. Equal rows get
    places next to each other; which of them comes first is open. ``group`` must not be NULL.
    """
    stored = durable(df.withColumn("__tie", F.monotonically_increasing_id()), "rows")
    ranged = stored.repartitionByRange(F.col(group), *order, F.col("__tie"))
    pieces = durable(ranged.withColumn("__piece", F.spark_partition_id()), "pieces")
    totals = pieces.groupBy(group, "__piece").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "__piece", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__piece").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(offsets, [group, "__piece"])
        .withColumn(into, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__tie", "__piece", "__offset")
    )
