"""Ratio-of-sums statistics of dated facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.functions.scalars import ratio_of_sums
from predlens.operators.windows import with_trailing_ratio


@dataclass(frozen=True)
class RatioColumns:
    """Column names of the facts (counters per game and key) and of the games (dates).

    The key may be a column of either frame.
    """

    key: str = "batter"
    game: str = "game_id"
    date: str = "local_date"
    num: str = "Hit"
    den: str = "atBat"


def per_game(facts: DataFrame, games: DataFrame, c: RatioColumns) -> DataFrame:
    """One dated row per (game, key).

    The facts are summed before the join, on the join's own key: the sums of a game are
    where the join needs them, and a game with very many facts arrives as few rows.
    """
    fact_keys = [c.game] + ([c.key] if c.key in facts.columns else [])
    sums = facts.groupBy(*fact_keys).agg(F.sum(c.num).alias(c.num), F.sum(c.den).alias(c.den))
    game_columns = [c.game, F.col(c.date).cast("date").alias(c.date)]
    if c.key not in facts.columns:
        game_columns.append(c.key)
    return sums.join(games.select(*game_columns), c.game)


def annual_ratio(
    facts: DataFrame, games: DataFrame, c: RatioColumns = RatioColumns(), out: str = "annual_ratio"
) -> DataFrame:
    """Ratio per key and calendar year."""
    dated = per_game(facts, games, c)
    return dated.groupBy(c.key, F.year(c.date).alias("year")).agg(
        ratio_of_sums(F.col(c.num), F.col(c.den), 3).alias(out)
    )


def historic_ratio(facts: DataFrame, c: RatioColumns = RatioColumns(), out: str = "historic_ratio") -> DataFrame:
    """Ratio per key over all facts."""
    return facts.groupBy(c.key).agg(ratio_of_sums(F.col(c.num), F.col(c.den), 3).alias(out))


def rolling_ratio(
    facts: DataFrame,
    games: DataFrame,
    c: RatioColumns = RatioColumns(),
    days: int = 100,
    out: str = "rolling_ratio",
) -> DataFrame:
    """Ratio per (key, game) over the trailing days, with the first day of that range.

    The range covers ``days`` days before the game's date and the date itself; games of
    one day count for each other. Early ranges are shorter than ``days``.
    """
    rows = with_trailing_ratio(
        per_game(facts, games, c), key=c.key, date=c.date, num=c.num, den=c.den, out=out, days=days
    )
    first_day = F.date_sub(c.date, days).alias(f"days_{days}_prior")
    return rows.select(c.key, c.game, c.date, first_day, out)
