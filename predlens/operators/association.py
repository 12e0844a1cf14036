"""Association between predictors: Pearson, correlation ratio, Cramér and Tschuprow."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predlens.functions.scalars import safe_ratio
from predlens.operators.sets import many_groupings
from predlens.session import durable

def column_pairs(left: Sequence[str], right: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """All pairs within one list, or across two."""
    return list(combinations(left, 2)) if right is None else list(product(left, right))


def pair_moments(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Number of rows with both values known and Pearson's r: ``(p1, p2, n, r)``.

    Two passes for any number of pairs and no shuffle but of one row: means and NULL counts
    first, then sums of products of the centred columns. A pair without NULLs shares its
    columns' sums of squares and adds one sum of its own. The result, a row per pair, is
    kept on the driver. NULL for a constant column.
    """
    names = sorted({name for pair in pairs for name in pair})
    place = {name: i for i, name in enumerate(names)}
    values = df.select(*[F.col(f"`{name}`").cast("double").alias(f"x{i}") for i, name in enumerate(names)])
    seen = values.agg(
        *[F.expr(text) for i in place.values() for text in (f"avg(x{i}) AS m{i}", f"count(x{i}) AS n{i}")],
        F.expr("count(*) AS n"),
    ).first()
    centred = values.selectExpr(*[f"x{i} - {seen[f'm{i}'] or 0.0!r}D AS x{i}" for i in place.values()])
    whole = {i for i in place.values() if seen[f"n{i}"] == seen["n"]}
    sums = {f"s{i}": f"x{i}" for i in whole} | {f"q{i}": f"x{i} * x{i}" for i in whole}
    for a, b in pairs:
        i, j = place[a], place[b]
        sums[f"p{i}_{j}"] = f"x{i} * x{j}"
        if not {i, j} <= whole:
            both = f"x{i} IS NOT NULL AND x{j} IS NOT NULL"
            sums |= {f"n{i}_{j}": f"IF({both}, 1D, NULL)"}
            for k, end in ((i, "l"), (j, "r")):
                sums |= {f"s{i}_{j}{end}": f"IF({both}, x{k}, NULL)", f"q{i}_{j}{end}": f"IF({both}, x{k} * x{k}, NULL)"}
    total = centred.agg(*[F.expr(f"sum({text}) AS {name}") for name, text in sums.items()]).first()

    rows = []
    for a, b in pairs:
        i, j = place[a], place[b]
        if {i, j} <= whole:
            n, ends = seen["n"], ((f"s{i}", f"q{i}"), (f"s{j}", f"q{j}"))
        else:
            n = int(total[f"n{i}_{j}"] or 0)
            ends = ((f"s{i}_{j}l", f"q{i}_{j}l"), (f"s{i}_{j}r", f"q{i}_{j}r"))
        rows.append((a, b, n, _correlation(n, *[(total[s], total[q]) for s, q in ends], total[f"p{i}_{j}"])))
    return df.sparkSession.createDataFrame(rows, "p1 string, p2 string, n bigint, r double")


def _correlation(n: int, left: tuple, right: tuple, product: float | None) -> float | None:
    """r from sums, sums of squares and the sum of products of nearly centred values."""
    if n < 2:
        return None
    (sx, qx), (sy, qy) = left, right
    xx, yy, xy = qx - sx * sx / n, qy - sy * sy / n, product - sx * sy / n
    # Equal values leave nothing but rounding.
    if xx <= 1e-13 * qx or yy <= 1e-13 * qy:
        return None
    return max(-1.0, min(1.0, xy / math.sqrt(xx * yy)))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's r of every pair of columns, ``(p1, p2, r)``."""
    return pair_moments(df, column_pairs(columns)).select("p1", "p2", "r")


def symmetric(pairs: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """Full matrix in long form: both directions of each pair, and 1 on the diagonal."""
    mirrored = pairs.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), value)
    ones = [F.struct(F.lit(c).alias("p1"), F.lit(c).alias("p2"), F.lit(1.0).alias(value)) for c in columns]
    diagonal = pairs.sparkSession.range(1).select(F.inline(F.array(*ones)))
    return pairs.select("p1", "p2", value).unionByName(mirrored).unionByName(diagonal)


def matrix(pairs: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """A long matrix as one row per ``p1`` and one column per name."""
    return pairs.groupBy("p1").pivot("p2", list(columns)).agg(F.first(value))


def correlation_ratio(df: DataFrame, categorical: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """Correlation ratio of each (continuous, categorical) pair, ``(p1, p2, eta)``.

    ``sqrt(between / total)``. Rows without category take no part in the group means nor
    in the grand mean, but their values count in the total; 0 where no means differ.
    """
    measures = []
    for i, name in enumerate(continuous):
        y = F.col(f"`{name}`").cast("double")
        measures += [
            F.count(y).alias(f"n{i}"), F.avg(y).alias(f"m{i}"), (F.var_pop(y) * F.count(y)).alias(f"s{i}")
        ]
    groups = many_groupings(df, {(name, ""): (name, None) for name in categorical}, measures)
    rows = [
        F.struct(
            F.lit(name).alias("p1"),
            F.col(f"n{i}").alias("n"),
            F.col(f"m{i}").alias("m"),
            F.col(f"s{i}").alias("s"),
        )
        for i, name in enumerate(continuous)
    ]
    known = F.col("known")
    cells = groups.select(
        F.col("p1").alias("p2"), F.col("b1").isNotNull().alias("known"), F.inline(F.array(*rows))
    )
    cells = durable(cells.filter(F.col("n") > 0), "groups")  # used twice
    grand = cells.groupBy("p1", "p2").agg(
        safe_ratio(F.sum(F.when(known, F.col("n") * F.col("m"))), F.sum(F.when(known, F.col("n")))).alias("grand")
    )
    # One row per pair of columns, so the broadcast is bounded by the column count.
    spread = F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)
    ratio = safe_ratio(F.col("between"), F.col("total"))
    return (
        cells.join(F.broadcast(grand), ["p1", "p2"])
        .groupBy("p1", "p2")
        .agg(F.sum(F.when(known, spread)).alias("between"), F.sum(F.col("s") + spread).alias("total"))
        .select("p1", "p2", F.when(F.col("between") == 0, 0.0).otherwise(F.sqrt(ratio)).alias("eta"))
    )


def missing_as_zero(df: DataFrame, column: str) -> Column:
    """The category with NULL replaced by category 0."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.StringType)):
        return F.coalesce(F.col(column), F.lit(0).cast(kind))
    return F.coalesce(F.col(column).cast("string"), F.lit("0"))


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Non-empty cells ``(p1, p2, b1, b2, o)`` of the crosstab of each pair."""
    columns = sorted({name for pair in pairs for name in pair})
    filled = df.select(*[missing_as_zero(df, name).alias(name) for name in columns])
    return many_groupings(filled, {pair: pair for pair in pairs}, [F.count("*").alias("o")])


def chi_square(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Chi-square of each pair's crosstab, plain and with Yates' correction on a 2x2 table.

    Empty cells are never built. Their share of chi-square is the sum of their expected
    counts, which is ``n`` less the expected counts of the other cells. In a 2x2 table all
    cells deviate by the same amount, so the sum of 1/expected gives the corrected value.
    """
    cells = durable(contingency(df, pairs), "cells")  # used four times
    rows = cells.groupBy("p1", "p2", "b1").agg(F.sum("o").alias("row_total"))
    columns = cells.groupBy("p1", "p2", "b2").agg(F.sum("o").alias("column_total"))
    tables = (
        rows.groupBy("p1", "p2").agg(
            F.count("*").alias("r"), F.sum("row_total").alias("n"), F.sum(1 / F.col("row_total")).alias("row_inverse")
        )
    ).join(
        columns.groupBy("p1", "p2").agg(
            F.count("*").alias("c"), F.sum(1 / F.col("column_total")).alias("column_inverse")
        ),
        ["p1", "p2"],
    )
    tables = F.broadcast(tables)  # one row per pair of columns
    expected = F.col("row_total") * F.col("column_total") / F.col("n")
    off = F.col("o") - F.col("e")
    sums = (
        cells.join(rows, ["p1", "p2", "b1"])
        .join(columns, ["p1", "p2", "b2"])
        .join(tables, ["p1", "p2"])
        .withColumn("e", expected)
        .groupBy("p1", "p2", "r", "c", "n", "row_inverse", "column_inverse")
        .agg(
            F.sum(off * off / F.col("e")).alias("filled"),
            F.sum("e").alias("filled_expected"),
            F.max(F.abs(off)).alias("off"),
        )
    )
    empty = F.greatest(F.col("n") - F.col("filled_expected"), F.lit(0.0))
    reduced = F.col("off") - F.least(F.lit(0.5), F.col("off"))
    corrected = reduced * reduced * F.col("n") * F.col("row_inverse") * F.col("column_inverse")
    plain = F.col("filled") + empty
    two_by_two = (F.col("r") == 2) & (F.col("c") == 2)
    return sums.select(
        "p1", "p2", "r", "c", "n", plain.alias("chi2"), F.when(two_by_two, corrected).otherwise(plain).alias("chi2_yates")
    )


def categorical_association(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Cramér's V and Tschuprow's T of each pair, bias-corrected and raw.

    The corrected measures use the plain chi-square, the raw ones Yates' on a 2x2 table.
    NULL where a column has only one category.
    """
    r, c, n = F.col("r") - 1, F.col("c") - 1, F.col("n")
    phi2 = F.col("chi2") / n
    raw_phi2 = F.col("chi2_yates") / n
    kept = F.greatest(F.lit(0.0), phi2 - safe_ratio(r * c, n - 1))
    rows, columns = r - safe_ratio(r * r, n - 1), c - safe_ratio(c * c, n - 1)

    def root(num: Column, den: Column) -> Column:
        return F.when(den > 0, F.sqrt(num / F.when(den > 0, den)))

    def mean_of(a: Column, b: Column) -> Column:
        return F.sqrt(F.greatest(a * b, F.lit(0.0)))

    return chi_square(df, pairs).select(
        "p1",
        "p2",
        "r",
        "c",
        "n",
        root(kept, F.least(rows, columns)).alias("cramers_v"),
        root(raw_phi2, F.least(r, c)).alias("cramers_v_raw"),
        root(kept, mean_of(rows, columns)).alias("tschuprow_t"),
        root(raw_phi2, mean_of(r, c)).alias("tschuprow_t_raw"),
    )
