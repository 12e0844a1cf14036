"""Whitening of embeddings by a weighted covariance over distinct vectors.

Vectors are taken at a fixed resolution, x = floor(64 c), so repeats are exactly equal. Equal x
are grouped once; their counts (or one each) weigh the centred product that gives the
covariance. Each distinct vector is whitened once and joined back to its rows.

Sums, counts and deviations are exact whole numbers. A constant added to all x cancels from
each of them and from x - S/n, so none is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.session import durable

RESOLUTION = 64
LARGEST = 2**31 - 1  # x beyond it are held at it, so that sums of x times counts stay whole numbers of 64 bits
COMPONENTS = 32
HOT = 1000  # a vector with more than one row in so many is joined by broadcast; there are fewer of them than this
FLAT = 1e-12  # components with less than this share of the greatest variance have no direction of their own


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` vectors (weights added up) with the sums ``sums``: axes by falling variance, one per column."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total_variance: float

    def explained(self) -> np.ndarray:
        return self.variances / self.total_variance

    def off_mean(self, x: np.ndarray) -> np.ndarray:
        """n x - S per row and dimension, exact: 64-bit numbers where they fit, else Python's."""
        whole = max(abs(s) for s in self.sums) + self.n * int(np.abs(x).max(initial=0)) < 2**62
        kind = np.int64 if whole else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.off_mean(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n x - S; None beyond 64 bits."""
        off = self.off_mean(x)
        if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) >= 2**62:
            off = off.astype(object)
        found = (off * off).sum(axis=1)
        return [int(d) if d < 2**63 else None for d in found]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.axes) / np.sqrt(self.variances)


def distinct_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x, copies): the vectors of sound rows at whole-number resolution, with their numbers of rows."""
    return _sound(df, vector).groupBy("__x").agg(F.count("*").alias("copies")).withColumnRenamed("__x", "x")


def _sound(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a usable vector, and ``__x``."""
    value = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(value, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    held = lambda c: F.floor(F.greatest(F.least(c * float(RESOLUTION), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return df.where(sound).withColumn("__x", F.transform(value, held))


def _cell_sums(distinct: DataFrame, vector: str, points, width: int) -> np.ndarray:
    """Sum over the weighted rows of the products of ``points(x)`` with themselves, a matrix.

    Every task makes one matrix; its cells are added up by Spark, and as many as the matrix has come back.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            p = points(np.stack(batch[vector].to_list()))
            total += (p * batch["weight"].to_numpy()[:, None].astype(float)).T @ p
        if total.any():
            yield pd.DataFrame({"cell": np.arange(width * width), "value": total.ravel()})

    cells = distinct.select(vector, "weight").mapInPandas(products, "cell long, value double")
    sums = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    found = np.zeros(width * width)
    found[sums["cell"]] = sums["value"]
    return found.reshape(width, width)


def fit(distinct: DataFrame, *, weights: str = "counts", components: int = COMPONENTS) -> Whitening | None:
    """Axes of the weighted covariance of ``distinct`` (x, copies); None if no direction has variance.

    ``weights`` is "counts", so that every row counts, or "one", so that every distinct vector does.
    """
    rows = distinct.withColumn("weight", _weight(weights))
    place = rows.select("weight", F.posexplode("x").alias("place", "value"))
    sums = place.groupBy("place").agg(F.sum(F.col("value").cast("decimal(20,0)") * F.col("weight")).alias("sum"), F.sum("weight").alias("n")).orderBy("place").collect()
    if not sums:
        return None
    n, width = int(sums[0]["n"]), len(sums)
    whitening = Whitening(n, [int(row["sum"]) for row in sums], np.eye(width), np.ones(width), 1.0)
    covariance = _cell_sums(rows, "x", whitening.centred, width) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = np.argsort(-values, kind="stable")[:components]
    kept = kept[values[kept] > FLAT * max(values.max(), 0.0)]
    if not len(kept):
        return None
    axes = axes[:, kept]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(kept))])  # the largest entry is positive
    return Whitening(n, whitening.sums, axes, values[kept], float(np.trace(covariance)))


def _weight(weights: str):
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    return F.col("copies") if weights == "counts" else F.lit(1).cast("long")


def whiten(df: DataFrame, vector: str = "embedding", *, weights: str = "counts", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """The sound rows of ``df`` with ``deviation`` and ``whitened``; the fit; how far the whitened covariance is off the identity.

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are left out, as are rows
    of another length than most (of lengths equally frequent: than the longest). Directions without
    variance are no components: of a single distinct vector there are none, and of it and of an
    empty table no row comes back. ``deviation`` is NULL beyond 64 bits. Repeated rows stay repeated;
    columns of the new names are replaced, others pass through.
    """
    counted = durable(distinct_vectors(df, vector), "distinct")
    lengths = counted.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).head()
    counted = counted.where(F.size("x") == (lengths["width"] if lengths else 0))
    whitening = fit(counted, weights=weights, components=components)
    rows = _sound(df, vector).drop("deviation", "whitened")
    if whitening is None:
        return rows.where("false").drop("__x").withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}), None, 0.0
    shared = df.sparkSession.sparkContext.broadcast(whitening)  # as large as the covariance, whatever the rows

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_list()) if len(batch) else np.zeros((0, len(shared.value.sums)), np.int64)
            yield batch.assign(deviation=pd.array(shared.value.deviations(x), "Int64"), whitened=list(shared.value.whitened(x)))

    once = durable(counted.mapInPandas(answered, "x array<int>, copies long, deviation long, whitened array<double>"), "whitened")
    width = len(whitening.variances)
    with_one = lambda z: np.concatenate([z, np.ones((len(z), 1))], axis=1)
    moments = _cell_sums(once.withColumn("weight", _weight(weights)), "whitened", with_one, width + 1) / whitening.n
    covariance = moments[:width, :width] - np.outer(moments[:width, width], moments[:width, width])
    error = float(np.abs(covariance - np.eye(width)).max())
    return _joined_back(rows, once), whitening, error


def _joined_back(rows: DataFrame, once: DataFrame) -> DataFrame:
    """Each row with the answer of its vector. Frequent vectors meet their rows where these lie, the others by a shuffle."""
    limit = once.agg(F.sum("copies")).first()[0] // HOT
    answers = once.select(F.col("x").alias("__x"), "deviation", "whitened", "copies")
    hot = F.broadcast(answers.where(F.col("copies") > limit).drop("copies"))
    near = rows.join(hot, "__x")
    far = rows.join(hot.select("__x"), "__x", "left_anti").join(answers.where(F.col("copies") <= limit).drop("copies"), "__x")
    return near.unionByName(far).drop("__x")
