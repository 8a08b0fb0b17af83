"""Group statistics as a Spark ML stage, for pipelines, validators and saved models."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from clickloom.operators.encoder import NAMED, QUANTILES, GroupEncoder, GroupModel
from clickloom.schema import feature_name
from clickloom.sources.store import load_table, roundtrip, save_table


class _EncoderParams(Params):
    keyCols = Param(Params._dummy(), "keyCols", "key columns", TypeConverters.toListString)
    targetCol = Param(Params._dummy(), "targetCol", "column the statistic is of", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the feature; from the keys and the statistic when not set", TypeConverters.toString)
    statistic = Param(Params._dummy(), "statistic", f"one of {', '.join([*NAMED, *QUANTILES])}", TypeConverters.toString)
    quantile = Param(Params._dummy(), "quantile", "the quantile, for statistic = quantile", TypeConverters.toFloat)
    minCount = Param(Params._dummy(), "minCount", "keys with fewer rows get null", TypeConverters.toInt)

    def feature(self) -> str:
        if self.isSet(self.outputCol):
            return self.getOrDefault(self.outputCol)
        return feature_name(self.getOrDefault(self.keyCols), self.getOrDefault(self.statistic))


class GroupStatistic(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a statistic of a target per key; `GroupEncoder` by the rules of an ML stage.

    Unseen keys and keys with a null get null. A fold of a validator fits on its own rows only.
    """

    @keyword_only
    def __init__(self, *, keyCols=None, targetCol=None, outputCol=None, statistic="mean", quantile=0.5, minCount=0):
        super().__init__()
        self._setDefault(statistic="mean", quantile=0.5, minCount=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> GroupStatisticModel:
        how = self.getOrDefault(self.statistic)
        kwargs = {"q": self.getOrDefault(self.quantile)} if how == "quantile" else {}
        encoder = GroupEncoder(
            self.getOrDefault(self.keyCols), self.getOrDefault(self.targetCol), how, self.feature(), self.getOrDefault(self.minCount), kwargs)
        model = GroupStatisticModel(roundtrip(encoder.fit(dataset).table, "statistic"))
        return self._copyValues(model)


class GroupStatisticModel(Model, _EncoderParams, MLReadable, MLWritable):
    """One row per key, joined to the rows that are transformed."""

    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return GroupModel(self.getOrDefault(self.keyCols), self.feature(), self.table).transform(dataset)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: GroupStatisticModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc)
        save_table(self.model.table, f"{path}/table")


class _ModelReader(MLReader):
    def load(self, path: str) -> GroupStatisticModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = GroupStatisticModel(load_table(self.sparkSession, f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
