"""Trailing ratios kept up to date on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from predlens.functions.scalars import half_up, safe_ratio

BUCKETS = 1024  # of keys whose state is kept together
ENTRY = ["key", "day", "num", "den"]


def trailing_ratio_stream(
    df: DataFrame, *, key: str, date: str, num: str, den: str, out: str, days: int = 100, late: int | None = None, digits: int = 3,
    buckets: int | None = BUCKETS,
) -> DataFrame:
    """``(key, day, num, den, out)``: the trailing ratio of every day that a batch of the stream changes.

    The state is the sums per key and day. Rows of a batch are summed by key and day where they are
    read, so a frequent key sends a few rows a task, and its state has one entry a day however many
    rows it has. Keys share the state of one of ``buckets`` by their hash, as a call of Python per
    key would cost more than its rows; a batch reads and writes the buckets that its keys are in.
    ``None`` gives each key a state of its own, for batches of few keys. A row changes its own day
    and the days of the key up to ``days`` later, whenever it comes; the last row given for a (key, day)
    holds. With ``late``, days more than ``days + late`` before a key's newest one are forgotten, and rows
    ``late`` days before it are too late and dropped; without it every day is kept. Rows without a key or
    date take no part. Needs output mode update.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.unix_date(F.col(date).cast("date")).alias("day"), F.col(num).cast("double").alias("num"), F.col(den).cast("double").alias("den"))
    summed = rows.filter("key IS NOT NULL AND day IS NOT NULL").mapInPandas(_by_day, f"key {kind}, day int, num double, den double")
    by, changed, entry = "bucket", _changed_buckets(days, late), "entries binary"
    if buckets is None:
        by, changed, entry = "key", _changed_days(days, late), "days array<int>, num array<double>, den array<double>"
    else:
        summed = summed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    changed = summed.groupBy(by).applyInPandasWithState(changed, f"key {kind}, day int, num double, den double", entry, "update", GroupStateTimeout.NoTimeout)
    ratio = half_up(safe_ratio(F.col("num"), F.col("den")), digits)
    return changed.select(F.col("key").alias(key), F.date_from_unix_date("day").alias("day"), F.col("num").alias(num), F.col("den").alias(den), ratio.alias(out))


def _by_day(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby(["key", "day"], as_index=False)[["num", "den"]].sum()


def _changed_days(days: int, late: int | None):
    """One key's changed days; its state is its days and their sums."""

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            at, num, den = state.get
            held = pd.DataFrame({"key": [key[0]] * len(at), "day": at, "num": num, "den": den})
        held, out = _moved(held, batches, days, late)
        state.update(tuple(held[name].tolist() for name in ENTRY[1:]))
        if len(out):
            yield out

    return changed


def _changed_buckets(days: int, late: int | None):
    """The changed days of a bucket's keys; its state is their entries as an Arrow stream."""

    def changed(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        held, out = _moved(held, batches, days, late)
        table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as written:
            written.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        if len(out):
            yield out

    return changed


def _moved(held: pd.DataFrame | None, batches: Iterator[pd.DataFrame], days: int, late: int | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The sums per key and day that are held after a batch, and the trailing sums of the days it changes."""
    parts = [batch[ENTRY] for batch in batches]
    rows = pd.concat(parts if held is None else [held, *parts], ignore_index=True)
    held = () if held is None else held
    code, keys = pd.factorize(rows["key"])
    day, sums = rows["day"].to_numpy(np.int64), rows[["num", "den"]].to_numpy(float)
    fresh = np.arange(len(rows)) >= len(held)
    if late is not None:
        newest = np.full(len(keys), -(2**62))
        np.maximum.at(newest, code[~fresh], day[~fresh])
        taken = ~fresh | (day >= newest[code] - late)
        code, day, sums, fresh = code[taken], day[taken], sums[taken], fresh[taken]
    # One entry per key and day, in this order; what is held is added to first.
    order = np.lexsort((day, code))
    code, day, sums, fresh = code[order], day[order], sums[order], fresh[order]
    begins = np.append(True, (code[1:] != code[:-1]) | (day[1:] != day[:-1]))
    entry = np.cumsum(begins) - 1
    sums = np.stack([np.bincount(entry, sums[:, side]) for side in (0, 1)], axis=1)
    touched = np.bincount(entry, fresh) > 0
    code, day = code[begins], day[begins]
    # A day is changed if a touched one of its key lies in its trailing range.
    last = np.maximum.accumulate(np.where(touched, np.arange(len(day)), -1))
    mine = (last >= 0) & (code == code[last]) & (day - day[last] <= days)
    if late is not None:
        newest = np.full(len(keys), -(2**62))
        np.maximum.at(newest, code, day)
        kept = day >= newest[code] - late - days
        code, day, sums, mine = code[kept], day[kept], sums[kept], mine[kept]
    held = pd.DataFrame({"key": keys.take(code), "day": day.astype("int32"), "num": sums[:, 0], "den": sums[:, 1]})
    line = code * (int(np.ptp(day)) + days + 1 if len(day) else 1) + day
    at = np.flatnonzero(mine)
    spans = np.stack([np.searchsorted(line, line[at] - days), at + 1], axis=1).ravel()
    trailing = np.add.reduceat(np.append(sums, np.zeros((1, 2)), axis=0), spans, axis=0)[::2] if len(at) else np.zeros((0, 2))
    return held, pd.DataFrame({"key": keys.take(code[at]), "day": day[at].astype("int32"), "num": trailing[:, 0], "den": trailing[:, 1]})
