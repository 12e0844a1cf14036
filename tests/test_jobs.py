"""Sources, sinks, scalar rules, team statistics, the report and time buckets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predlens.functions import scalars as S
from predlens.operators import profile, teams
from predlens.plans import games as G
from predlens.plans.measurements import FLOWER_CLASS, FLOWER_MEASURES, class_profile, coded, flower_rows
from predlens.plans.report import predictor_report
from predlens.session import durable, scratch_folder
from predlens.sources import sinks, tables
from predlens.sources.datasets import Dataset, Registry, sample_registry
from predlens.streaming.buckets import tumbling


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


# --- scalar rules ---


def test_ratios_and_rounding(spark):
    assert value(spark, S.safe_ratio(F.lit(7), F.lit(2))) == 3.5
    assert value(spark, S.safe_ratio(F.lit(7), F.lit(0))) is None
    assert value(spark, S.half_up(F.lit(0.0625), 3)) == 0.063
    assert value(spark, S.half_even(F.lit(0.0625), 3)) == 0.062
    assert value(spark, S.half_up(F.lit(-0.0625), 3)) == -0.063


def test_maps_and_flags(spark):
    codes = {"TRUE": 1, "FALSE": 0}
    for text, code in (("TRUE", 1), ("FALSE", 0), ("x", None), (None, None)):
        assert value(spark, S.value_map(F.lit(text).cast("string"), codes)) == code
    for outcome, flag in (("L", "FALSE"), ("W", "TRUE"), (None, "TRUE")):
        assert value(spark, S.loss_flag(F.lit(outcome).cast("string"))) == flag
    for x, flag in ((1.5, 0), (-1.6, 1), (None, 0)):
        assert value(spark, S.exceeds(F.lit(x).cast("double"), 1.5)) == flag


def test_text(spark):
    assert value(spark, S.scientific(F.lit(0.000123456789))) == "1.234568e-04"
    assert value(spark, S.suffix_after(F.lit("diff_ERA"), "diff")) == "_ERA"
    assert value(spark, S.suffix_after(F.lit("home_ERA"), "diff")) is None
    assert value(spark, S.page_stem(F.lit("plots/a_b.html"))) == "a_b"
    assert value(spark, S.page_stem(F.lit("a_b.png"))) is None


def test_unsigned_rejects_null_and_negative(spark):
    good = spark.createDataFrame([(3,)], "g int").select(S.unsigned(F.col("g"), "g").alias("g"))
    assert good.schema["g"].dataType == T.LongType() and good.first()["g"] == 3
    for bad in (None, -1):
        df = spark.createDataFrame([(bad,)], "g int")
        with pytest.raises(Exception, match="g: NULL or negative"):
            df.select(S.unsigned(F.col("g"), "g")).collect()


# --- sources and sinks ---


def test_headerless_csv(spark, tmp_path):
    path = tmp_path / "flowers.data"
    path.write_text("5.1,3.5,1.4,0.2,setosa\n4.9,3.0,1.4,0.2,setosa\n7.0,3.2,4.7,1.4,versicolor\n\n")
    rows = flower_rows(spark, str(path))
    assert rows.columns == [*FLOWER_MEASURES, FLOWER_CLASS, "line"] and rows.count() == 3
    whole = class_profile(rows, FLOWER_MEASURES, FLOWER_CLASS).collect()
    cut = class_profile(rows, FLOWER_MEASURES, FLOWER_CLASS, without_last="line").collect()
    sepal = FLOWER_MEASURES[0]
    means = {(r["scope"], r["group"]): r["mean"] for r in cut if r["column"] == sepal}
    assert means == {("overall", None): 5.0, ("group", "setosa"): 5.1}
    assert {(r["scope"], r["group"]) for r in whole} == {
        ("overall", None), ("group", "setosa"), ("group", "versicolor")
    }
    assert {(r["class"], r["label"]) for r in coded(rows, "class").collect()} == {("setosa", 0.0), ("versicolor", 1.0)}


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:mysql://h/db", table="game", driver="d", properties={"user": "u"})
    assert plain == {
        "user": "u", "url": "jdbc:mysql://h/db?zeroDateTimeBehavior=CONVERT_TO_NULL", "driver": "d", "dbtable": "game",
    }
    split = tables.jdbc_options("jdbc:x:y", query="SELECT 1", slices=tables.Slices("id", "0", "9", 4))
    assert split["dbtable"] == "(SELECT 1) sliced" and split["numPartitions"] == "4"
    assert split["partitionColumn"] == "id" and "query" not in split
    assert tables.jdbc_options("jdbc:x:y", query="SELECT 1")["query"] == "SELECT 1"
    assert tables.zero_dates_as_null("jdbc:mariadb://h/db?a=1").endswith("?a=1&zeroDateTimeBehavior=CONVERT_TO_NULL")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x:y")


def test_tables_replaced_and_kept(spark):
    one, two = spark.range(1), spark.range(2)
    assert sinks.create_or_replace(one, "t_replaced").count() == 1
    assert sinks.create_or_replace(two, "t_replaced").count() == 2
    assert sinks.create_if_absent(one, "t_absent").count() == 1
    assert sinks.create_if_absent(two, "t_absent").count() == 1
    kept = sinks.keep_on_disk(two)
    assert kept.count() == 2 and kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    kept.unpersist()


def test_failed_writes_leave_tables_alone(spark, tmp_path):
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    for path in (None, str(tmp_path / "t")):
        name = "t_safe" if path is None else "t_safe_path"
        sinks.create_or_replace(spark.range(4), name, path)
        with pytest.raises(Exception, match="broken"):
            sinks.create_or_replace(broken, name, path)
        assert spark.table(name).count() == 4
        # The frame may read the table it replaces, with the same columns or others.
        assert sinks.create_or_replace(spark.table(name).filter("id > 0"), name, path).count() == 3
        other = spark.table(name).select(F.col("id").cast("string").alias("text"))
        assert [r["text"] for r in sinks.create_or_replace(other, name, path).orderBy("text").collect()] == ["1", "2", "3"]
    assert len(list((tmp_path / "t").iterdir())) == 1  # versions before are removed
    with pytest.raises(Exception, match="broken"):
        sinks.create_if_absent(broken, "t_never")
    assert not spark.catalog.tableExists("t_never")
    spark.range(2).write.mode("overwrite").saveAsTable("t_managed")
    assert sinks.create_or_replace(spark.table("t_managed").filter("id = 1"), "t_managed").count() == 1


def test_sql_over_views(spark):
    assert tables.sql_frame(spark, "SELECT count(*) AS n FROM v_three", {"v_three": spark.range(3)}).first()["n"] == 3


def test_registry(spark, tmp_path):
    rows = [(1, 4, None), (2, 6, 2.0), (3, 8, 3.0)]
    load = lambda s: s.createDataFrame(rows, "row int, CHAS int, target double")
    registry = Registry().add("one", Dataset(load, "target", categorical=["CHAS"], complete=True, index_by=["row"]))
    roles = registry.get(spark)
    assert roles.predictors == ["row", "CHAS"] and roles.response == "target"
    assert [(r["index"], r["CHAS"]) for r in roles.df.orderBy("row").collect()] == [(1, "6"), (2, "8")]
    with pytest.raises(ValueError, match="unknown dataset"):
        registry.get(spark, "two")
    spark.createDataFrame([(1.0, "f", "n", "Sun", "Lunch", 2, 3.0)], "total_bill double, sex string, smoker string, "
                          "day string, time string, size int, tip double").write.parquet(str(tmp_path / "tips.parquet"))
    tips = sample_registry(str(tmp_path)).get(spark, "tips")
    assert tips.response == "tip" and len(tips.predictors) == 6 and tips.df.count() == 1


def test_durable_cuts_the_lineage(spark):
    cut = durable(spark.range(10).filter("id > 3"))
    assert sorted(r["id"] for r in cut.collect()) == [4, 5, 6, 7, 8, 9]
    assert "Filter" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert scratch_folder(spark, "x") != scratch_folder(spark, "x")


# --- team statistics ---


def test_rates_of_empty_denominators(spark):
    batting = spark.createDataFrame(
        [(1, 1, 2, 4, 1, 1, 0, 1, 0), (1, 1, 1, 4, 0, 1, 1, 0, 1), (2, 1, 0, 0, 0, 0, 0, 0, 0)],
        "game_id int, team_id int, Hit int, atBat int, Home_Run int, Strikeout int, Sac_Fly int, Walk int, "
        "Hit_By_Pitch int",
    )
    rows = {r["game_id"]: (r["BA"], r["BABIP"], r["OBP"]) for r in teams.team_game_rates(batting).collect()}
    assert rows[1] == (3 / 8, 2 / 6, 5 / 11) and rows[2] == (None, None, None)


def test_league_and_team_joins(spark):
    pitching = spark.createDataFrame(
        [(1, 1, 7, 1, 3, 9, 5, 1, 1, 2, 3, 0, 0), (1, 2, 8, 1, 1, 4, 2, 0, 1, 1, 1, 1, 3), (2, 9, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1)],
        "game_id int, team_id int, pitcher int, startingInning int, endingInning int, atBat int, outsPlayed int, "
        "Home_Run int, Walk int, Strikeout int, Hit int, Fly_Out int, Flyout int",
    )
    dims = spark.createDataFrame([(1, "N", "E"), (2, "N", "W"), (3, "A", "E")], "team_id int, league string, division string")
    totals = teams.league_totals(pitching, dims)
    row = totals.collect()
    assert len(row) == 1  # team 9 plays in no league
    assert (row[0]["lgIP"], row[0]["lgHR"], row[0]["lgHRFB"]) == (4, 1, 0.0)
    assert row[0]["lgERA"] == ((9 - 5) / 2 + (4 - 2) / 2) / 4 * 9
    constants = teams.team_constants(totals, dims).collect()
    assert {r["team_id"] for r in constants} == {1, 2}
    assert constants[0]["C"] == 6.75 - (13 * 1 + 3 * 2 - 2 * 3) / 4


def test_roles_meet_once_per_game(spark):
    games = spark.createDataFrame([(1, 10, 20), (2, 20, 10), (3, 10, 30), (4, 20, 20)], "game_id int, home_team_id int, away_team_id int")
    bats = spark.createDataFrame([(1, 10, 0.1), (1, 20, None), (2, 10, 0.3), (2, 20, 0.4), (3, 10, 0.5), (4, 20, 0.6)], "game_id int, team_id int, BA double")
    arms = bats.select("game_id", "team_id", (F.col("BA") * 10).alias("ERA"), F.lit("N").alias("league"))
    wide = teams.both_roles(games, [(bats, ["BA"]), (arms, ["ERA", "league"])])
    rows = {r["game_id"]: r for r in wide.collect()}
    assert set(rows) == {1, 2, 4}  # game 3 lacks its away team
    assert rows[1]["home_BA"] == 0.1 and rows[1]["away_BA"] is None
    assert rows[2]["home_BA"] == 0.4 and rows[2]["away_ERA"] == 3.0
    assert rows[4]["home_BA"] == rows[4]["away_BA"] == 0.6
    side = teams.role_join(games, bats, "home", ["BA"]).collect()
    assert {r["game_id"]: r["home_BA"] for r in side} == {1: 0.1, 2: 0.4, 3: 0.5, 4: 0.6}


def test_differences(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "home_ERA double, away_ERA double")
    assert teams.with_differences(df, ["ERA"]).first()["diff_ERA"] == 2.0
    assert len(G.ALL_PREDICTORS) == 24 and set(G.TOP_PREDICTORS) < set(G.ALL_PREDICTORS)


# --- profile and report ---


def test_null_class_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0)], "c string, x double")
    means = {(r["scope"], r["group"]): r["mean"] for r in profile.describe(df, ["x"], by="c").collect()}
    assert means == {("overall", None): 2.0, ("group", "a"): 1.0, ("group", None): 3.0}


def report_frame(spark):
    rows = [
        (float(i % 7), float((i * 5) % 13), "ab"[i % 2], i % 3, bool((i * 3) % 7 > 2 or i % 5 == 0), float(i % 7 + i % 2))
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "x double, w double, c string, k int, won boolean, score double")


@pytest.mark.parametrize("response", ["won", "score"])
def test_report(spark, response, tmp_path):
    report = predictor_report(report_frame(spark), ["x", "w", "c", "k"], response)
    assert set(report.sections) == {
        "ranking", "cont_cont_correlation", "cont_cont_matrix", "cont_cont_slopes", "cont_cont_effects",
        "cont_cat_correlation", "cont_cat_matrix", "cont_cat_effects",
        "cat_cat_correlation", "cat_cat_matrix", "cat_cat_effects",
    }
    ranking = {r["predictor"]: r for r in report.sections["ranking"].collect()}
    assert set(ranking) == {"x", "w", "c", "k"}
    assert ranking["x"]["p_value"] is not None and ranking["c"]["p_value"] is None
    assert ranking["k"]["wmsd"] is not None
    effects = [r["wmsd"] for r in report.sections["cont_cat_effects"].collect()]
    assert effects == sorted(effects, reverse=True) and len(effects) == 4
    if response == "won":
        for path in report.write(str(tmp_path)):
            assert spark.read.parquet(path).count() > 0


def test_report_of_one_kind(spark):
    df = report_frame(spark)
    only_text = predictor_report(df, ["c", "k"], "won").sections
    assert set(only_text) == {"ranking", "cat_cat_correlation", "cat_cat_matrix", "cat_cat_effects"}
    assert only_text["ranking"].count() == 2
    assert set(predictor_report(df, ["x"], "score").sections) == {"ranking"}


# --- time buckets ---


def test_buckets_on_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=7 * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    batch = tumbling(df, "ts", F.count("*").alias("n"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        tumbling(stream, "ts", F.count("*").alias("n"), late="1 day")
        .writeStream.outputMode("complete").format("memory").queryName("buckets")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("buckets").select("bucket_start", "n").collect())) == sorted(
        map(tuple, batch.select("bucket_start", "n").collect())
    )


def test_workers_need_no_copy_of_the_package(tmp_path, data):
    """From a folder without the package, with the driver's own path alone."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from predlens.catalogue import all_queries
from predlens.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
print("rows", all_queries()["knn3"](spark, {data!r}).count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
