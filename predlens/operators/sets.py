"""One aggregation over many small groupings of the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groupings per pass: every row is repeated once per grouping inside the task, and wide
# lists of groupings would outgrow the generated code.
GROUPINGS_PER_PASS = 32


def many_groupings(
    df: DataFrame, groupings: Mapping[tuple[str, str], tuple[str, str | None]], measures: Sequence[Column]
) -> DataFrame:
    """Aggregate by each grouping; rows ``(p1, p2, b1, b2, <measures>)`` in one long frame.

    ``groupings`` maps the two names of a result to the one or two columns to group by
    (``None`` for a grouping of one). Group values come out as text. Partial aggregation
    leaves no more than the cells of all groupings to shuffle, whatever the row count.
    """
    names = list(groupings)
    parts = []
    for start in range(0, len(names), GROUPINGS_PER_PASS):
        parts.append(_one_pass(df, {name: groupings[name] for name in names[start : start + GROUPINGS_PER_PASS]}, measures))
    return reduce(DataFrame.unionByName, parts)


def _one_pass(df: DataFrame, groupings: Mapping, measures: Sequence[Column]) -> DataFrame:
    columns = sorted({column for pair in groupings.values() for column in pair if column is not None})
    sets = list(dict.fromkeys(tuple(sorted(c for c in pair if c is not None)) for pair in groupings.values()))
    grouped = df.groupingSets([list(s) for s in sets], *columns).agg(F.grouping_id().alias("_set"), *measures)
    # grouping_id has a bit per column, the first column highest, set where it is not grouped by.
    top = len(columns) - 1
    ids = {s: sum(1 << (top - i) for i, c in enumerate(columns) if c not in s) for s in sets}

    results = []
    for (p1, p2), (c1, c2) in groupings.items():
        key = tuple(sorted(c for c in (c1, c2) if c is not None))
        second = F.lit(None) if c2 is None else F.col(c2)
        results.append(
            F.when(
                F.col("_set") == ids[key],
                F.struct(
                    F.lit(p1).alias("p1"),
                    F.lit(p2).alias("p2"),
                    F.col(c1).cast("string").alias("b1"),
                    second.cast("string").alias("b2"),
                ),
            )
        )
    others = [name for name in grouped.columns if name not in columns and name != "_set"]
    # Two results may share a grouping, hence a list per group rather than a single choice.
    labelled = grouped.select(F.explode(F.array_compact(F.array(*results))).alias("_cell"), *others)
    return labelled.select("_cell.*", *others)
