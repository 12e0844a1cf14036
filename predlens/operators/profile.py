"""Column profiles, group statistics and crosstabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.functions.bins import edge_columns
from predlens.functions.scalars import exceeds, ratio_of_sums, safe_ratio

EDGE_BINS = 4


def describe(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Mean, minimum, maximum and five equal-width edges of each column.

    With ``by``, overall and per group in one pass (``scope`` tells them apart). One row
    per scope, group and column.
    """
    measures = [
        measure
        for name in columns
        for measure in (
            F.avg(name).alias(f"{name}.mean"), F.min(name).alias(f"{name}.min"), F.max(name).alias(f"{name}.max")
        )
    ]
    if by is None:
        wide = df.agg(*measures).withColumns({"scope": F.lit("overall"), "group": F.lit(None).cast("string")})
    else:
        grouped = df.groupingSets([[by], []], F.col(by)).agg(F.grouping_id().alias("_level"), *measures)
        scope = F.when(F.col("_level") == 0, "group").otherwise("overall")
        wide = grouped.withColumns({"scope": scope, "group": F.col(by).cast("string")})
    rows = []
    for name in columns:
        lo, hi = F.col(f"`{name}.min`").cast("double"), F.col(f"`{name}.max`").cast("double")
        edges = edge_columns(lo, hi, EDGE_BINS)
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"`{name}.mean`").alias("mean"),
                lo.alias("min"),
                hi.alias("max"),
                *[edge.alias(label) for label, edge in edges.items()],
            )
        )
    return wide.select("scope", "group", F.inline(F.array(*rows)))


def group_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and count per group beside the population's mean, range and row count.

    The population is totalled from the groups, so the rows are read once.
    """
    groups = df.groupBy(by).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("answers"), F.min(value).alias("_min"),
        F.max(value).alias("_max"), F.count("*").alias("_rows"),
    )
    population = groups.agg(
        ratio_of_sums(F.col("_sum"), F.col("answers")).alias("population_mean"),
        F.min("_min").alias("population_min"),
        F.max("_max").alias("population_max"),
        F.sum("_rows").alias("population_rows"),
    )
    whole = population.select(F.struct("*").alias("p")).scalar()
    mean = safe_ratio(F.col("_sum"), F.col("answers")).alias("mean")
    return groups.select(by, mean, "answers", whole.alias("_p")).select(by, "mean", "answers", "_p.*")


def crosstab(df: DataFrame, rows: str, columns: str, value: str | None = None) -> DataFrame:
    """Cells of a crosstab in long form: count, and the mean of ``value`` if given."""
    measures = [F.count("*").alias("rows")]
    if value is not None:
        measures.append(F.avg(value).alias("mean"))
    return df.groupBy(rows, columns).agg(*measures)


def crosstab_wide(df: DataFrame, rows: str, columns: str, labels: Sequence) -> DataFrame:
    """Counts with one column per label of ``columns``; labels are given, so one pass suffices."""
    pivoted = df.groupBy(rows).pivot(columns, list(labels)).count()
    return pivoted.na.fill(0)


def crosstab_shape(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Grand total, number of row and of column labels, and the largest cell of a crosstab."""
    cells = crosstab(df, rows, columns)
    return cells.agg(
        F.sum("rows").alias("total"),
        F.count_distinct(rows).alias("row_labels"),
        F.count_distinct(columns).alias("column_labels"),
        F.max("rows").alias("largest"),
    )


def confusion_flags(df: DataFrame, left: str, right: str, left_limit: float, right_limit: float) -> DataFrame:
    """Crosstab of two threshold flags, ``abs(value) > limit``."""
    flags = df.select(
        exceeds(F.col(left), left_limit).alias("left_flag"), exceeds(F.col(right), right_limit).alias("right_flag")
    )
    return crosstab(flags, "left_flag", "right_flag")
