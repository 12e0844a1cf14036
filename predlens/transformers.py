"""Pipeline stages."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from predlens.operators.windows import with_trailing_ratio


class TrailingRatio(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the trailing-days ratio of two counters per key as column ``outputCol``."""

    key = Param(Params._dummy(), "key", "column whose rows belong together", TypeConverters.toString)
    date = Param(Params._dummy(), "date", "date or timestamp column", TypeConverters.toString)
    num = Param(Params._dummy(), "num", "numerator counter", TypeConverters.toString)
    den = Param(Params._dummy(), "den", "denominator counter", TypeConverters.toString)
    days = Param(Params._dummy(), "days", "days before each row's date", TypeConverters.toInt)
    decimals = Param(Params._dummy(), "decimals", "decimals of the ratio", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, key="batter", date="local_date", num="Hit", den="atBat", days=100, decimals=3,
        outputCol="rolling_ratio",
    ):
        super().__init__()
        self._setDefault(
            key="batter", date="local_date", num="Hit", den="atBat", days=100, decimals=3,
            outputCol="rolling_ratio",
        )
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(
        self, *, key="batter", date="local_date", num="Hit", den="atBat", days=100, decimals=3,
        outputCol="rolling_ratio",
    ):
        return self._set(**self._input_kwargs)

    def setKey(self, value):
        return self._set(key=value)

    def getKey(self):
        return self.getOrDefault(self.key)

    def setDate(self, value):
        return self._set(date=value)

    def getDate(self):
        return self.getOrDefault(self.date)

    def setNum(self, value):
        return self._set(num=value)

    def getNum(self):
        return self.getOrDefault(self.num)

    def setDen(self, value):
        return self._set(den=value)

    def getDen(self):
        return self.getOrDefault(self.den)

    def setDays(self, value):
        return self._set(days=value)

    def getDays(self):
        return self.getOrDefault(self.days)

    def setDecimals(self, value):
        return self._set(decimals=value)

    def getDecimals(self):
        return self.getOrDefault(self.decimals)

    def setOutputCol(self, value):
        return self._set(outputCol=value)

    def _transform(self, dataset):
        return with_trailing_ratio(
            dataset,
            key=self.getKey(),
            date=self.getDate(),
            num=self.getNum(),
            den=self.getDen(),
            out=self.getOutputCol(),
            days=self.getDays(),
            digits=self.getDecimals(),
        )
