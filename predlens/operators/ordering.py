"""Order-dependent operators without a global sort in one task.

The rows are dealt into ranges of the whole sort key, ties of which are broken by the place a
row was read at, so that no value is too frequent to be cut. A row's position is the number of
rows in the ranges before its own plus its rank there; a range is a shuffle partition, so its
size is what ``spark.sql.shuffle.partitions`` makes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predlens.session import durable


def with_piece(df: DataFrame, order: Sequence[str], out: str, *, pieces: int | None = None) -> DataFrame:
    """Add the number of the order piece each row lies in, and write the rows down with it.

    Pieces follow the order, NULL first and NaN last. ``pieces`` is at most that many; by
    default it is the number of shuffle partitions.
    """
    keys = [*order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(*keys) if pieces is None else tied.repartitionByRange(pieces, *keys)
    return durable(cut.withColumn(out, F.spark_partition_id()).drop("_tie"), "pieces")


def with_position(
    df: DataFrame, order: Sequence[str], out: str, *, start: int = 1, pieces: int | None = None
) -> DataFrame:
    """Number the rows in a stated order, without gaps."""
    placed = with_piece(df, order, "_cut", pieces=pieces)
    sizes = placed.groupBy("_cut").agg(F.count("*").alias("_size"))
    # One row per piece: one task is enough here.
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_cut", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_cut").orderBy(*order))
    ranked = placed.withColumn("_rank", within).join(offsets, "_cut")
    position = F.col("_offset") + F.col("_rank") + F.lit(start - 1)
    return ranked.select(*df.columns, position.cast("bigint").alias(out))


def dense_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Distinct non-NULL values with their number in sorted order, from 0."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return with_position(values, [column], out, start=0)


def drop_last(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Leave out the last row (of each group) in the order of a unique column.

    Takes one maximum per group instead of ranking the groups' rows. Rows without an order
    value stand first and stay.
    """
    if not by:
        last = df.agg(F.max(order).alias("_last")).select("_last").scalar()
        return df.filter(F.col(order).isNull() | (F.col(order) < last))
    last = df.groupBy(*by).agg(F.max(order).alias("_last"))
    condition = [df[name].eqNullSafe(last[name]) for name in by] + [df[order] == last["_last"]]
    return df.join(last, condition, "left_anti")


def top_rows(df: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """First rows in a stated order; each task keeps no more than ``count``."""
    return df.orderBy(*order).limit(count)


def ranked(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """Highest score first, missing scores last."""
    return df.orderBy(F.col(score).desc_nulls_last(), *ties)
