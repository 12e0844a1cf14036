"""Profile of labelled measurements, such as the flower data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predlens.models.suite import Effort, compare
from predlens.operators.ordering import dense_codes, drop_last
from predlens.operators.profile import describe
from predlens.session import durable
from predlens.sources.tables import named_csv

# Columns of the flower measurements file, which has no header.
FLOWER_MEASURES = ["sepal length in cm", "sepal width in cm", "petal length in cm", "petal width in cm"]
FLOWER_CLASS = "class"
LINE = "line"


def flower_rows(spark: SparkSession, path: str) -> DataFrame:
    """The flower measurements with their place in the file."""
    columns = {**{name: T.DoubleType() for name in FLOWER_MEASURES}, FLOWER_CLASS: T.StringType()}
    return named_csv(spark, path, columns, line=LINE)


def class_profile(df: DataFrame, measures: Sequence[str], by: str, without_last: str | None = None) -> DataFrame:
    """Mean, range and edges of each measure, overall and per class.

    ``without_last`` names a unique column; the profile then leaves out the last row in its
    order: of all rows for the overall part, of each class for the classes' part.
    """
    if without_last is None:
        return describe(df, measures, by=by)
    overall = describe(drop_last(df, without_last), measures)
    by_class = describe(drop_last(df, without_last, by=[by]), measures, by=by)
    return overall.unionByName(by_class.filter(F.col("scope") == "group"))


def coded(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    """Add the label's number in sorted order, for models."""
    codes = dense_codes(df, label, out)
    return df.join(codes, label).withColumn(out, F.col(out).cast("double"))


def training_scores(
    df: DataFrame, measures: Sequence[str], label: str, key: str, models: Sequence[str] | None = None, effort: Effort = Effort()
) -> DataFrame:
    """Accuracy of each classifier on the rows it was fitted to: ``(model, accuracy)``.

    The label may have any number of values. Rows without a measure or label take no part.
    """
    rows = durable(coded(df.select(key, label, *measures).na.drop("any"), label, "_code"), "training")
    scores = compare(rows, rows, {"all": list(measures)}, label="_code", key=key, models=models, effort=effort)
    return scores.select("model", "accuracy")
