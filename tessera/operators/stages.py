"""Feature preparation as Spark ML stages, so that one saved model takes raw rows
(FE-13, FE-14, IS-4, IS-5).

* :class:`FeatureBuilder` learns the categories of the configured columns; its
  model applies the whole feature configuration and conforms the result to the
  training columns.
* :class:`GroupMedianImputer` learns a median per group.  Groups may be many, so
  its state is a table: it stays a DataFrame and is saved as Parquet beside the
  metadata.
* :class:`Standardizer` learns the mean and deviation of its columns.

A ``Pipeline`` of these and any estimator is fitted, saved, loaded and applied
as one, the same way in training and in scoring.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from tessera.operators import features as FT
from tessera.operators import impute as IM


class _FeatureParams(Params):
    config = Param(Params._dummy(), "config", "feature configuration as JSON", TypeConverters.toString)
    categories = Param(Params._dummy(), "categories", "values of each encoded column as JSON", TypeConverters.toString)
    outputCols = Param(Params._dummy(), "outputCols", "columns of the result in order", TypeConverters.toListString)
    carry = Param(Params._dummy(), "carry", "input columns kept in front of the features", TypeConverters.toListString)


class FeatureBuilderModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """The configured features of raw rows (FE-14): ``carry``, then the training
    columns in their order; an absent one is 0."""

    def _transform(self, df: DataFrame) -> DataFrame:
        carry = self.getOrDefault(self.carry)
        return FT.scoring_features(df, json.loads(self.getOrDefault(self.config)), json.loads(self.getOrDefault(self.categories)),
                                   [*carry, *self.getOrDefault(self.outputCols)])


class FeatureBuilder(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the categories of ``config``'s encoded columns (FE-13).  ``config``
    must be plain data (it is kept as JSON).  The label of ``config`` is no
    feature: carry the columns that later stages need besides."""

    def __init__(self, config: Mapping | None = None, carry: Sequence[str] = ()):
        super().__init__()
        self._set(config=json.dumps(config or {}), carry=list(carry))

    def _fit(self, df: DataFrame) -> FeatureBuilderModel:
        config = json.loads(self.getOrDefault(self.config))
        config.pop("target", None)
        found = FT.fit_categories(df, config)
        made = FT.feature_pipeline(df, config, found).columns
        kept = [c for c in config.get("features_to_keep") or made if c not in self.getOrDefault(self.carry)]
        out = FeatureBuilderModel()
        out._set(config=json.dumps(config), categories=json.dumps(found), outputCols=kept, carry=self.getOrDefault(self.carry))
        return out


class _GroupParams(Params):
    groupCol = Param(Params._dummy(), "groupCol", "column of the group", TypeConverters.toString)
    targetCol = Param(Params._dummy(), "targetCol", "column that is filled", TypeConverters.toString)


class GroupMedianImputerModel(Model, _GroupParams, MLReadable, MLWritable):
    """Nulls of ``targetCol`` become the median of the row's group; null groups
    and those unseen in training stay null.  ``medians`` is the learned table
    (``_g, _gm``)."""

    def __init__(self, medians: DataFrame | None = None):
        super().__init__()
        self.medians = medians

    def _transform(self, df: DataFrame) -> DataFrame:
        return IM.impute_group_median(df, self.getOrDefault(self.groupCol), self.getOrDefault(self.targetCol),
                                      stats=self.medians)

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class GroupMedianImputer(Estimator, _GroupParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, groupCol: str = "", targetCol: str = ""):
        super().__init__()
        self._set(groupCol=groupCol, targetCol=targetCol)

    def _fit(self, df: DataFrame) -> GroupMedianImputerModel:
        group, target = self.getOrDefault(self.groupCol), self.getOrDefault(self.targetCol)
        # computed once: every later transform reads this table, in the shared folder
        from tessera.session import scratch_path
        path = scratch_path(df.sparkSession, "group-medians")
        IM.group_medians(df, group, target).write.parquet(path)
        out = GroupMedianImputerModel(df.sparkSession.read.parquet(path))
        out._set(groupCol=group, targetCol=target)
        return out


class _TableWriter(MLWriter):
    def __init__(self, model: GroupMedianImputerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.medians.write.parquet(f"{path.rstrip('/')}/data")


class _TableReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(self.sparkSession.read.parquet(f"{path.rstrip('/')}/data"))
        DefaultParamsReader.getAndSetParams(out, metadata)
        out._resetUid(metadata["uid"])
        return out


class _ScaleParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", TypeConverters.toListString)
    ddof = Param(Params._dummy(), "ddof", "1: sample, 0: population deviation", TypeConverters.toInt)
    eps = Param(Params._dummy(), "eps", "added to the deviation", TypeConverters.toFloat)
    stats = Param(Params._dummy(), "stats", "mean and deviation of each column as JSON", TypeConverters.toString)


class StandardizerModel(Model, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / (deviation + eps)`` of the columns that are present."""

    def _transform(self, df: DataFrame) -> DataFrame:
        stats = {c: tuple(v) for c, v in json.loads(self.getOrDefault(self.stats)).items() if c in df.columns}
        return IM.standardize(df, list(stats), self.getOrDefault(self.ddof), self.getOrDefault(self.eps), stats)


class Standardizer(Estimator, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """IS-5 / IS-6 as a stage: one aggregate for all columns."""

    def __init__(self, inputCols: Sequence[str] = (), ddof: int = 1, eps: float = 1e-9):
        super().__init__()
        self._set(inputCols=list(inputCols), ddof=ddof, eps=eps)

    def _fit(self, df: DataFrame) -> StandardizerModel:
        stats = IM.fit_standardize(df, self.getOrDefault(self.inputCols), self.getOrDefault(self.ddof))
        out = StandardizerModel()
        out._set(inputCols=list(stats), ddof=self.getOrDefault(self.ddof), eps=self.getOrDefault(self.eps),
                 stats=json.dumps({c: [None if v is None else float(v) for v in s] for c, s in stats.items()}))
        return out
