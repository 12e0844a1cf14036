"""Random Fourier features (Rahimi and Recht, 2007): an RBF kernel as plain columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Maps a vector of ``width`` numbers to ``size`` numbers whose products approximate the kernel."""

    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the input vectors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, gamma=1.0, size=256, width=None, seed=0, inputCol="features", outputCol="fourier"):
        super().__init__()
        self._setDefault(gamma=1.0, size=256, seed=0, inputCol="features", outputCol="fourier")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.size), self.getOrDefault(self.width)
        chance = np.random.default_rng(self.getSeed())
        waves = chance.normal(scale=math.sqrt(2 * self.getOrDefault(self.gamma)), size=(width, size))
        shifts = chance.uniform(0, 2 * math.pi, size=size)

        @F.pandas_udf("array<double>")
        def project(vectors: pd.Series) -> pd.Series:
            points = np.array(vectors.tolist(), dtype=float)
            return pd.Series(list(math.sqrt(2 / size) * np.cos(points @ waves + shifts)))

        projected = array_to_vector(project(vector_to_array(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), projected)
