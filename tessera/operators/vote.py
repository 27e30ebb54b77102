"""The soft vote as a Spark ML model that can be saved, loaded and scored (CV-5).

A :class:`VoteModel` holds fitted pipelines and weights.  Its writer puts the
weights and the threshold into the metadata and each member, with its own
writer, into a folder of its own; its reader loads them back, so a vote is
registered under one name and version like any other model.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import decide

PROBABILITY, RAW = "probability", "rawPrediction"


def positive_score(pred: DataFrame) -> Column:
    """Score of the positive class: P(1) when the model gives probabilities,
    else the raw margin (LinearSVC) — enough for rank metrics."""
    c = F.col(PROBABILITY if PROBABILITY in pred.columns else RAW)
    return F.when(c.isNotNull(), vector_to_array(c)[1])


class VoteModel(Model, MLReadable, MLWritable):
    """Weighted mean of the members' positive probabilities.

    ``transform`` adds ``probability`` (a vector of two) and ``prediction``;
    input columns of these names (and ``rawPrediction``) are replaced.  What the
    members add besides does not stay."""

    weights = Param(Params._dummy(), "weights", "weight of each member", TypeConverters.toListFloat)
    threshold = Param(Params._dummy(), "threshold", "least probability of a positive prediction", TypeConverters.toFloat)

    def __init__(self, members: Sequence[tuple[float, PipelineModel]] = (), threshold: float = 0.5):
        super().__init__()
        self.models = [m for _, m in members]
        self._set(weights=[float(w) for w, _ in members], threshold=threshold)
        if members and (any(w < 0 for w, _ in members) or sum(w for w, _ in members) <= 0):
            raise ValueError("weights must not be negative and at least one must be positive")

    @property
    def members(self) -> list[tuple[float, PipelineModel]]:
        return list(zip(self.getOrDefault(self.weights), self.models, strict=True))

    def copy(self, extra=None):
        out = super().copy(extra)
        out.models = [m.copy(extra) for m in self.models]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("a vote needs members")
        kept = [F.col(f"`{c}`") for c in df.columns if c not in (PROBABILITY, RAW, "prediction")]
        names = [f"_vote{i}" for i in range(len(self.models))]
        d = df.select(*kept)
        for i, m in enumerate(self.models):
            p = m.transform(d)
            d = p.select(*kept, *names[:i], positive_score(p).alias(names[i]))
        weights = self.getOrDefault(self.weights)
        score = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(names, weights, strict=True)]) / sum(weights)
        return d.withColumn("_score", score).drop(*names) \
            .withColumn(PROBABILITY, F.when(F.col("_score").isNotNull(), array_to_vector(F.array(1 - F.col("_score"), F.col("_score"))))) \
            .withColumn("prediction", decide("_score", self.getOrDefault(self.threshold)).cast("double")).drop("_score")

    def write(self) -> MLWriter:
        return VoteWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return VoteReader()


def _member_path(path: str, i: int) -> str:
    return f"{path.rstrip('/')}/members/{i:04d}"


class VoteWriter(MLWriter):
    def __init__(self, vote: VoteModel):
        super().__init__()
        self.vote = vote

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.vote, path, self.sparkSession,
                                         extraMetadata={"members": len(self.vote.models)})
        for i, m in enumerate(self.vote.models):
            m.write().save(_member_path(path, i))


class VoteReader(MLReader):
    def load(self, path: str) -> VoteModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = VoteModel()
        DefaultParamsReader.getAndSetParams(out, metadata)
        out._resetUid(metadata["uid"])
        out.models = [PipelineModel.load(_member_path(path, i)) for i in range(metadata["members"])]
        return out


class LinearScorer(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A logistic model given by its coefficients: ``probability`` of ``1 / (1 +
    exp(-(intercept + weights . x)))`` and ``prediction``.  A null input gives a
    null probability."""

    inputCols = Param(Params._dummy(), "inputCols", "input columns", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "coefficient of each input", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def __init__(self, inputCols: Sequence[str] = (), weights: Sequence[float] = (), intercept: float = 0.0):
        super().__init__()
        self._set(inputCols=list(inputCols), weights=[float(w) for w in weights], intercept=float(intercept))

    def _transform(self, df: DataFrame) -> DataFrame:
        terms = [F.col(f"`{c}`").cast("double") * F.lit(w)
                 for c, w in zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.weights), strict=True)]
        margin = reduce(lambda a, b: a + b, terms, F.lit(self.getOrDefault(self.intercept)))
        p = F.lit(1.0) / (1 + F.exp(-margin))
        return df.withColumn(PROBABILITY, F.when(p.isNotNull(), array_to_vector(F.array(1 - p, p)))) \
            .withColumn("prediction", decide(p, 0.5).cast("double"))
