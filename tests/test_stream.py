"""Trailing ratios on a stream whose keys share their state."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from predlens.operators.windows import with_trailing_ratio
from predlens.streaming.trailing import _changed_buckets, _changed_days, trailing_ratio_stream


class State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, new):
        self.exists, self.get = True, new


def said_by(frames):
    return sorted((k, d, n, m) for frame in frames for k, d, n, m in frame[["key", "day", "num", "den"]].itertuples(index=False))


@pytest.mark.parametrize("late", [None, 0, 30])
@pytest.mark.parametrize("name", [int, str])
def test_shared_states_say_what_states_of_their_own_say(late, name):
    random = np.random.default_rng(7)
    shared, own = State(), {}
    for step in range(6):
        rows = pd.DataFrame({"key": [name(k) for k in random.integers(0, 6, 80)], "day": random.integers(0, 60, 80) + 40 * step - 30, "num": random.integers(0, 9, 80).astype(float), "den": 1.0})
        found = said_by(_changed_buckets(50, late)((0,), iter([rows[:30], rows[30:]]), shared))
        parts = [(key, part) for key, part in rows.groupby("key")]
        assert found == said_by(out for key, part in parts for out in _changed_days(50, late)((key,), iter([part]), own.setdefault(key, State())))


@pytest.mark.parametrize("buckets", [1, 3, None])
def test_any_number_of_buckets(spark, tmp_path, buckets):
    random = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=int(d)) for d in random.integers(0, 300, 600)]
    rows = [(f"k{k}", day, int(h), 1) for k, day, h in zip(random.integers(0, 40, 600), days, random.integers(0, 2, 600))]
    df = spark.createDataFrame([*rows, (None, days[0], 1, 1)], "who string, local_date date, Hit int, atBat int")
    for part in df.randomSplit([1.0] * 3, 5):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    said = {}
    ratios = trailing_ratio_stream(stream, key="who", date="local_date", num="Hit", den="atBat", out="r", days=50, buckets=buckets)
    take = lambda batch, _: said.update({(r["who"], r["day"]): r["r"] for r in batch.collect()})
    ratios.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    batch = with_trailing_ratio(df, key="who", date="local_date", num="Hit", den="atBat", out="r", days=50).filter("who IS NOT NULL")
    assert said == {(r["who"], r["local_date"]): r["r"] for r in batch.collect()}


def test_python_is_not_called_for_every_key(spark, tmp_path):
    df = spark.range(5).selectExpr("id AS who", "DATE'2020-01-01' AS local_date", "1 AS Hit", "1 AS atBat")
    df.write.parquet(str(tmp_path / "in"))
    ratios = trailing_ratio_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), key="who", date="local_date", num="Hit", den="atBat", out="r")
    plan = ratios._jdf.queryExecution().analyzed().toString()
    grouped = next(line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line)
    assert ", [bucket#" in grouped
