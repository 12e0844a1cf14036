"""Trailing windows: edges of the ranges, and chunked against plain windows."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from predlens.operators.ratios import RatioColumns, annual_ratio, historic_ratio, rolling_ratio
from predlens.operators.windows import trailing_row_means, with_trailing_ratio
from predlens.streaming.trailing import _changed_days, trailing_ratio_stream
from predlens.transformers import TrailingRatio

DAY = dt.date(2020, 6, 1)


def dated(spark, rows):
    return spark.createDataFrame(
        [(k, DAY + dt.timedelta(days=d), n, m) for k, d, n, m in rows], "batter int, local_date date, Hit int, atBat int"
    )


def ratios(spark, rows):
    out = with_trailing_ratio(
        dated(spark, rows), key="batter", date="local_date", num="Hit", den="atBat", out="r"
    ).collect()
    return sorted(((x["batter"], (x["local_date"] - DAY).days, x["r"]) for x in out), key=str)


def test_range_ends_are_inclusive(spark):
    assert ratios(spark, [(1, 0, 1, 1), (1, 100, 0, 1)]) == [(1, 0, 1.0), (1, 100, 0.5)]
    assert ratios(spark, [(1, 0, 1, 1), (1, 101, 0, 1)]) == [(1, 0, 1.0), (1, 101, 0.0)]


def test_rows_of_one_day_are_peers_and_keys_are_apart(spark):
    assert ratios(spark, [(1, 0, 1, 2), (1, 0, 0, 2), (2, 0, 3, 4)]) == [(1, 0, 0.25), (1, 0, 0.25), (2, 0, 0.75)]


def test_no_denominator_gives_null(spark):
    assert ratios(spark, [(1, 0, 0, 0)]) == [(1, 0, None)]


def test_row_without_date_is_kept(spark):
    df = spark.createDataFrame([(1, None, 1, 1)], "batter int, local_date date, Hit int, atBat int")
    out = with_trailing_ratio(df, key="batter", date="local_date", num="Hit", den="atBat", out="r").collect()
    assert [(x["batter"], x["r"]) for x in out] == [(1, None)]


def test_ratio_rounds_halves_up(spark):
    assert ratios(spark, [(1, 0, 1, 16)]) == [(1, 0, 0.063)]  # 0.0625


@pytest.fixture(scope="module")
def season(spark):
    chance = random.Random(5)
    games = [(g, DAY + dt.timedelta(days=chance.randrange(400))) for g in range(60)]
    facts = [
        (g, b, chance.randrange(3), 3 + chance.randrange(3)) for g, _ in games for b in range(4) if chance.random() < 0.7
    ]
    return (
        spark.createDataFrame(facts, "game_id int, batter int, Hit int, atBat int"),
        spark.createDataFrame(games, "game_id int, local_date date"),
    )


def test_rolling_equals_correlated_subquery(spark, season):
    facts, games = season
    facts.createOrReplaceTempView("bc")
    games.createOrReplaceTempView("gm")
    expected = spark.sql(
        """WITH d AS (SELECT b.*, g.local_date FROM bc b JOIN gm g ON g.game_id = b.game_id)
           SELECT b.batter, b.game_id, (
             SELECT round(CAST(sum(c.Hit) / nullif(sum(c.atBat), 0) AS DECIMAL(38, 9)), 3) FROM d c
             WHERE c.batter = b.batter AND c.local_date BETWEEN date_sub(b.local_date, 100) AND b.local_date) AS r
           FROM d b"""
    )
    ours = rolling_ratio(facts, games).select("batter", "game_id", F.col("rolling_ratio").alias("r"))
    assert sorted(map(tuple, ours.collect())) == sorted((a, b, float(c)) for a, b, c in expected.collect())


def test_key_may_be_a_column_of_either_frame(spark, season):
    facts, games = season
    single = facts.filter("batter = 1").drop("batter")
    owners = games.withColumn("batter", F.lit(1))
    left = rolling_ratio(facts.filter("batter = 1"), games).collect()
    assert sorted(map(tuple, left)) == sorted(map(tuple, rolling_ratio(single, owners).collect()))


def test_annual_and_historic(spark):
    facts = spark.createDataFrame([(1, 7, 1, 4), (2, 7, 2, 4), (3, 8, 0, 0)], "game_id int, batter int, Hit int, atBat int")
    games = spark.createDataFrame(
        [(1, dt.date(2019, 5, 1)), (2, dt.date(2020, 5, 1)), (3, dt.date(2020, 5, 1))], "game_id int, local_date date"
    )
    assert sorted(map(tuple, annual_ratio(facts, games).collect()), key=str) == [
        (7, 2019, 0.25), (7, 2020, 0.5), (8, 2020, None),
    ]
    assert sorted(map(tuple, historic_ratio(facts, RatioColumns()).collect()), key=str) == [(7, 0.375), (8, None)]


def test_transformer_in_a_pipeline_and_on_disk(spark, season, tmp_path):
    facts, games = season
    rows = facts.join(games, "game_id")
    stage = TrailingRatio(days=30, outputCol="form")
    assert (stage.getDays(), stage.getDecimals(), stage.getOutputCol()) == (30, 3, "form")
    once = Pipeline(stages=[stage]).fit(rows).transform(rows)
    assert once.columns == [*rows.columns, "form"]
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = TrailingRatio.load(str(tmp_path / "stage")).transform(rows)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    assert stage.setKey("k").getKey() == "k"


# --- row windows ---


def test_first_row_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, 8.0)], "team int, game int, x double")
    out = trailing_row_means(df, key="team", order="game", measures=["x"], rows=2).orderBy("game").collect()
    assert [row["x"] for row in out] == [None, 2.0, 2.0, 4.0]


@pytest.fixture(scope="module")
def games_of_teams(spark):
    """One team with most rows, many with few, spread over all order values."""
    chance = random.Random(3)
    rows = [(1, g, chance.random(), "a") for g in range(0, 3000) if chance.random() < 0.9]
    for team in range(2, 40):
        rows += [(team, g, chance.random(), "b") for g in chance.sample(range(3000), chance.randrange(1, 40))]
    return spark.createDataFrame(rows, "team int, game int, x double, tag string").repartition(6).cache()


def rounded(df):
    return [(r["team"], r["game"], r["tag"], None if r["x"] is None else round(r["x"], 9)) for r in df.collect()]


def plain_means(df, rows):
    """Previous-row means key by key, in Python."""
    by_team = {}
    for r in df.collect():
        by_team.setdefault(r["team"], []).append((r["game"], r["tag"], r["x"]))
    found = []
    for team, games in by_team.items():
        games.sort()
        for i, (game, tag, _) in enumerate(games):
            before = [x for _, _, x in games[max(0, i - rows) : i]]
            found.append((team, game, tag, round(sum(before) / len(before), 9) if before else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("rows", [1, 5, 50])
@pytest.mark.parametrize("chunk", [1, 60, 100000])
def test_chunks_do_not_change_the_means(games_of_teams, rows, chunk):
    """However the rows are cut, and for the NULL key like for any other."""
    df = games_of_teams.withColumn("team", F.expr("nullif(team, 1)"))
    out = trailing_row_means(df, key="team", order="game", measures=["x"], rows=rows, chunk_rows=chunk)
    assert sorted(rounded(out), key=str) == plain_means(df, rows)


def test_no_window_by_key_alone(games_of_teams):
    out = trailing_row_means(games_of_teams, key="team", order="game", measures=["x"], rows=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "avg" in line]
    assert windows and all("_chunk" in line for line in windows)


def test_trailing_ratio_on_a_stream(spark, tmp_path):
    """Whatever comes late, the last word on each day is what a batch over all rows says."""
    chance = random.Random(5)
    rows = [(chance.choice([1, 1, 1, 2, 3, None]), chance.randrange(400), chance.randrange(2), 1) for _ in range(900)]
    rows += [(4, None, 1, 1), (5, 3, 0, 0)]
    df = spark.createDataFrame(
        [(k, None if d is None else DAY + dt.timedelta(days=d), n, m) for k, d, n, m in rows], "batter int, local_date date, Hit int, atBat int"
    )
    for i, part in enumerate(df.randomSplit([1.0] * 4, 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    said = {}

    def take(batch, _):
        said.update({(r["batter"], r["day"]): r["r"] for r in batch.collect()})

    ratios = trailing_ratio_stream(stream, key="batter", date="local_date", num="Hit", den="atBat", out="r", days=50)
    running = ratios.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(take).start()
    running.awaitTermination()
    batch = with_trailing_ratio(df, key="batter", date="local_date", num="Hit", den="atBat", out="r", days=50).filter("batter IS NOT NULL AND local_date IS NOT NULL")
    assert said == {(r["batter"], r["local_date"]): r["r"] for r in batch.collect()} and said[5, DAY + dt.timedelta(days=3)] is None


def test_days_of_a_stream_are_forgotten():
    class State:
        exists, get = True, ([0, 60, 100], [1.0, 1.0, 1.0], [1.0, 2.0, 2.0])

        def update(self, new):
            self.new = new

    state = State()
    batch = pd.DataFrame({"key": [1, 1, 1], "day": [120, 95, 70], "num": [1.0, 1.0, 1.0], "den": [1.0, 1.0, 1.0]})
    [out] = _changed_days(50, 10)((1,), iter([batch]), state)
    assert state.new == ([60, 95, 100, 120], [1.0, 1.0, 1.0, 1.0], [2.0, 1.0, 2.0, 1.0])  # 70 was too late, 0 is out of reach
    assert out[["day", "num", "den"]].values.tolist() == [[95, 2.0, 3.0], [100, 3.0, 5.0], [120, 3.0, 4.0]]
