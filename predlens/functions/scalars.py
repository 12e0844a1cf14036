"""Scalar expressions used by every job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is 0."""
    return num / F.nullif(den, F.lit(0))


def half_up(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, halves away from zero.

    The value passes through a decimal first: binary doubles just below a half
    (0.0625 written as 0.06249999999999999) would otherwise round the wrong way.
    """
    return F.round(value.cast("decimal(38,9)"), digits).cast("double")


def half_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, halves to the even digit."""
    return F.bround(value.cast("decimal(38,9)"), digits).cast("double")


def ratio_of_sums(num: Column, den: Column, digits: int | None = None) -> Column:
    """Aggregate ``sum(num) / sum(den)``; NULL without any denominator."""
    ratio = safe_ratio(F.sum(num), F.sum(den))
    return ratio if digits is None else half_up(ratio, digits)


def value_map(value: Column, codes: Mapping) -> Column:
    """Replace each value by its code; values without a code become NULL."""
    result = None
    for key, code in codes.items():
        hit = value == F.lit(key)
        result = F.when(hit, F.lit(code)) if result is None else result.when(hit, F.lit(code))
    return result


def exceeds(value: Column, limit: float) -> Column:
    """1 where ``abs(value) > limit``, else 0 (also for NULL)."""
    return F.when(F.abs(value) > F.lit(limit), 1).otherwise(0)


def loss_flag(outcome: Column) -> Column:
    """Text flag of a game outcome: only an explicit loss ``L`` is FALSE, NULL is TRUE."""
    return F.when(outcome == "L", F.lit("FALSE")).otherwise(F.lit("TRUE"))


def pair_label(left: Column, right: Column) -> Column:
    """The text ``left and right``."""
    return F.concat_ws(" and ", left, right)


def scientific(value: Column, digits: int = 6) -> Column:
    """Scientific notation such as ``1.234560e-07``, for printed reports only."""
    return F.format_string(f"%.{digits}e", value)


def suffix_after(value: Column, prefix: str) -> Column:
    """What follows ``prefix`` in names such as ``diff_ERA``; NULL if it does not start so."""
    found = F.regexp_extract(value, f"^{prefix}(\\w+)$", 1)
    return F.nullif(found, F.lit(""))


def page_stem(value: Column) -> Column:
    """Name of an ``.html`` file in a path, without folder and ending; NULL if there is none."""
    return F.nullif(F.regexp_extract(value, r".+/([^/]+)\.html$", 1), F.lit(""))


def unsigned(value: Column, name: str) -> Column:
    """The value as bigint; the job fails on NULL or on a negative value."""
    bad = value.isNull() | (value < 0)
    return F.when(bad, F.raise_error(F.lit(f"{name}: NULL or negative"))).otherwise(value).cast("bigint")
