"""Named datasets: where the rows come from, which columns predict and which one responds."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predlens.operators.ordering import with_position


@dataclass(frozen=True)
class Roles:
    """A frame with its predictor columns and its response column."""

    df: DataFrame
    predictors: list[str]
    response: str


@dataclass(frozen=True)
class Dataset:
    """A loader and the roles of its columns.

    ``predictors=None`` stands for every column but the response. ``categorical`` columns
    are read as text. ``complete`` drops rows with any NULL; ``index_by`` first numbers the
    rows from 0 in that order, so the numbers keep the gaps of the dropped rows.
    """

    load: Callable[[SparkSession], DataFrame]
    response: str
    predictors: list[str] | None = None
    categorical: list[str] = field(default_factory=list)
    complete: bool = False
    index_by: list[str] | None = None

    def roles(self, spark: SparkSession) -> Roles:
        df = self.load(spark)
        predictors = self.predictors or [name for name in df.columns if name != self.response]
        for name in self.categorical:
            df = df.withColumn(name, df[name].cast("string"))
        if self.index_by:
            df = with_position(df, self.index_by, "index", start=0)
        if self.complete:
            df = df.na.drop("any")
        return Roles(df, list(predictors), self.response)


# Roles of the sample datasets. The files themselves are the user's.
SAMPLE_ROLES = {
    "mpg": {
        "predictors": ["cylinders", "displacement", "horsepower", "weight", "acceleration", "origin"],
        "response": "mpg",
        "complete": True,
        "indexed": True,
    },
    "tips": {
        "predictors": ["total_bill", "sex", "smoker", "day", "time", "size"],
        "response": "tip",
        "complete": True,
        "indexed": True,
    },
    "titanic": {
        "predictors": ["pclass", "sex", "age", "sibsp", "embarked", "class"],
        "response": "survived",
        "complete": True,
    },
    "boston": {"predictors": None, "response": "target", "categorical": ["CHAS"]},
    "diabetes": {"predictors": None, "response": "target"},
    "breast_cancer": {"predictors": None, "response": "target"},
    "iris": {"predictors": None, "response": "target"},
}


class Registry:
    """Datasets by name."""

    def __init__(self) -> None:
        self._datasets: dict[str, Dataset] = {}

    def add(self, name: str, dataset: Dataset) -> Registry:
        self._datasets[name] = dataset
        return self

    def names(self) -> list[str]:
        return sorted(self._datasets)

    def get(self, spark: SparkSession, name: str | None = None) -> Roles:
        """Roles of a dataset, of a random one if no name is given."""
        if name is None:
            name = random.choice(self.names())
        if name not in self._datasets:
            raise ValueError(f"unknown dataset: {name}")
        return self._datasets[name].roles(spark)


def sample_registry(folder: str) -> Registry:
    """The sample datasets, read from ``folder/<name>.parquet``.

    Those that are ``indexed`` get their rows' places in the file as ``index``, gaps included.
    """
    registry = Registry()
    for name, how in SAMPLE_ROLES.items():
        roles = {key: value for key, value in how.items() if key != "indexed"}
        read = _in_file_order if how.get("indexed") else _as_stored
        registry.add(name, Dataset(load=partial(read, path=f"{folder}/{name}.parquet"), **roles))
    return registry


def _as_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _in_file_order(spark: SparkSession, path: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = _as_stored(spark, path).select("*", place.alias("_place"))
    return with_position(rows, ["_place"], "index", start=0).drop("_place")
