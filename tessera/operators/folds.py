"""Preparation of all cross-validation folds at once, and search by any metric on
Spark's tuning layer (CV-1..3).

For k folds a pipeline learns its medians, means and deviations k times, from
tables that are almost the same.  :class:`FoldTables` learns them in two
aggregates over the whole table (every statistic once per left-out fold) and gives
each fold's fit and prediction a projection of the kept table, which computes the
fold's vector.  The columns are kept once, not one vector per fold.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as MT
from tessera.operators import sample as SA
from tessera.operators.vote import positive_score


class FoldSpec(NamedTuple):
    """Columns that are scaled, columns that follow unscaled, kind of scaling."""
    scaled: tuple[str, ...]
    plain: tuple[str, ...]
    scaling: str | None


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _pooled(parts: Sequence[tuple[float, float, float]]) -> tuple[float, float]:
    """(mean, sample deviation) of groups given by (rows, mean, sum of squared
    deviations)."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    squares = sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)
    return mean, math.sqrt(squares / (n - 1)) if n > 1 else 0.0


def _statistics(df: DataFrame, fold_col: str, folds: Sequence, spec: FoldSpec, accuracy: int) -> dict:
    """``{fold: {column: (median, centre, divisor)}}`` from the rows outside the
    fold; null and NaN are missing.

    Counts, means and variances are taken once per fold and pooled on the driver
    (folds x columns numbers); medians, which do not pool, are asked for columns
    with missing values only, once per left-out fold in one aggregate."""
    cols = [*spec.scaled, *spec.plain]
    clean = df.select(fold_col, *[F.when(~F.isnan(_x(c)), _x(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = {r[fold_col]: r for r in clean.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n"), *[
        f(f"c{i}").alias(f"{k}{i}") for i in range(len(cols)) for f, k in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))]).collect()}
    outside = {f: [r for g, r in rows.items() if g != f] for f in folds}
    for f in folds:
        for i, c in enumerate(cols):
            if not sum(r[f"n{i}"] for r in outside[f]):
                raise ValueError(f"column {c!r} has no value outside fold {f!r}")

    def quantiles(x: Sequence[tuple], p: Sequence[float]) -> dict:
        """{(fold, column): quantiles} of the given (fold, column, expression)."""
        if not x:
            return {}
        found = clean.agg(*[F.percentile_approx(F.when(F.col(fold_col) != F.lit(f), e), list(p), accuracy).alias(f"q{k}")
                            for k, (f, _, e) in enumerate(x)]).first()
        return {(f, c): found[f"q{k}"] for k, (f, c, _) in enumerate(x)}
    missing = [i for i in range(len(cols)) if any(r[f"n{i}"] < r["n"] for r in rows.values())]
    median = {k: v[0] for k, v in quantiles([(f, i, F.col(f"c{i}")) for f in folds for i in missing], [0.5]).items()}
    out = {f: {c: (median.get((f, i), 0.0), 0.0, 1.0) for i, c in enumerate(cols)} for f in folds}
    if spec.scaling == "robust":
        filled = [(f, i, F.coalesce(F.col(f"c{i}"), F.lit(median.get((f, i), 0.0)))) for f in folds for i in range(len(spec.scaled))]
        spread = {k: (q[1], q[2] - q[0]) for k, q in quantiles(filled, [0.25, 0.5, 0.75]).items()}
    elif spec.scaling == "standard":
        spread = {}
        for f in folds:
            for i in range(len(spec.scaled)):
                parts = [(r[f"n{i}"], r[f"m{i}"], (r[f"v{i}"] or 0.0) * (r[f"n{i}"] - 1)) for r in outside[f] if r[f"n{i}"]]
                parts += [(r["n"] - r[f"n{i}"], median[f, i], 0.0) for r in outside[f] if r[f"n{i}"] < r["n"]]
                spread[f, i] = _pooled(parts)
    else:
        return out
    for (f, i), (centre, width) in spread.items():
        # a column without spread becomes 0, as in the scalers of the pipelines
        out[f][cols[i]] = (median.get((f, i), 0.0), centre, width or float("inf"))
    return out


class FoldTables:
    """The folds of ``df`` with prepared vectors, their statistics learnt once per
    kind of preparation.  A table that is not kept already is kept here, in even
    partitions; :meth:`release` drops it."""

    def __init__(self, df: DataFrame, key: str, label: str, fold_col: str, accuracy: int = 10_000):
        self.df, self.key, self.label, self.fold_col, self.accuracy = df, key, label, fold_col, accuracy
        self.sizes = {r[0]: r["count"] for r in df.groupBy(fold_col).count().collect()}
        self.made: dict[FoldSpec, DataFrame] = {}
        self.learnt: dict[FoldSpec, tuple[DataFrame, dict]] = {}
        self.kept: list[DataFrame] = []
        self.lock = threading.RLock()

    def prepared(self, spec: FoldSpec) -> tuple[DataFrame, dict]:
        """(kept table, ``{fold: {column: (median, centre, divisor)}}``)."""
        with self.lock:
            if spec not in self.learnt:
                stats = _statistics(self.df, self.fold_col, sorted(self.sizes), spec, self.accuracy)
                d = self.df
                if not d.is_cached:
                    used = dict.fromkeys([*self._keep(), *spec.scaled, *spec.plain])
                    d = SA.evenly(d.select(*[F.col(f"`{c}`") for c in used]), self.key, sum(self.sizes.values()))
                    self.kept.append(d.persist(StorageLevel.MEMORY_AND_DISK))
                self.learnt[spec] = d, stats
            return self.learnt[spec]

    def _keep(self) -> list[str]:
        return [c for c in dict.fromkeys([self.key, self.label, self.fold_col, "weight"]) if c in self.df.columns]

    def table(self, spec: FoldSpec) -> DataFrame:
        """Key, label, fold, weight (if there) and a vector ``x<j>`` for the j-th fold."""
        with self.lock:
            if spec not in self.made:
                folds = sorted(self.sizes)
                d, stats = self.prepared(spec)

                def vector(f) -> Column:
                    parts = []
                    for c in (*spec.scaled, *spec.plain):
                        m, centre, spread = stats[f][c]
                        x = F.coalesce(F.when(~F.isnan(_x(c)), _x(c)), F.lit(float(m)))
                        parts.append(x if (centre, spread) == (0.0, 1.0) else (x - F.lit(centre)) / F.lit(spread))
                    return array_to_vector(F.array(*parts))
                self.made[spec] = d.select(*[F.col(f"`{c}`") for c in self._keep()], *[vector(f).alias(f"x{j}") for j, f in enumerate(folds)])
            return self.made[spec]

    def fold(self, spec: FoldSpec, f, column: str) -> tuple[DataFrame, DataFrame]:
        """(training rows, held-out rows) of fold ``f`` with its vector as ``column``."""
        d = self.table(spec)
        rest = [F.col(f"`{c}`") for c in d.columns if not (c[0] == "x" and c[1:].isdigit())]
        d = d.select(*rest, F.col(f"x{sorted(self.sizes).index(f)}").alias(column))
        return d.where(F.col(self.fold_col) != F.lit(f)), d.where(F.col(self.fold_col) == F.lit(f))

    def release(self) -> None:
        for d in self.kept:
            d.unpersist()
        self.kept.clear()
        self.made.clear()
        self.learnt.clear()


class BinaryEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Any metric of :data:`metrics.METRICS` for Spark's ``CrossValidator`` and
    ``TrainValidationSplit``: f1, precision, recall, accuracy or the exact AUC."""

    metricName = Param(Params._dummy(), "metricName", "metric", TypeConverters.toString)

    def __init__(self, metricName: str = "roc_auc", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        if metricName not in MT.METRICS:
            raise ValueError(f"metric must be one of {MT.METRICS}")
        self._set(metricName=metricName, labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        metric = self.getOrDefault(self.metricName)
        score = [positive_score(dataset).alias("s")] if metric == "roc_auc" else []
        d = dataset.select(F.col(self.getLabelCol()).cast("int").alias("y"), F.col(self.getPredictionCol()).cast("int").alias("p"), *score)
        return float(MT.binary_metrics(d, "y", "p", "s" if score else None).first()[metric])

    def isLargerBetter(self) -> bool:
        return True


def tune(pipeline: Pipeline, grid: Mapping[str, Sequence], df: DataFrame, metric: str = "f1", label: str = "label",
         fold_col: str = "fold", parallelism: int = 2) -> tuple[CrossValidatorModel, DataFrame]:
    """CV-3 on Spark's tuning layer: every combination of ``grid`` ({parameter of
    the last stage: values}) by the mean of ``metric`` over the folds that
    ``fold_col`` names.  Returns the model refitted on all rows and ``rank, params,
    <metric>_mean`` of the combinations, best first (the first of equals wins)."""
    builder = ParamGridBuilder()
    last = pipeline.getStages()[-1]
    for name, values in grid.items():
        builder = builder.addGrid(last.getParam(name), list(values))
    maps = builder.build()
    k = df.agg(F.max(fold_col)).first()[0] + 1
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=BinaryEvaluator(metric, label), numFolds=k,
                        foldCol=fold_col, parallelism=parallelism)
    model = cv.fit(df.withColumn(fold_col, F.col(fold_col).cast("int")))
    rows = sorted(((float(v), i) for i, v in enumerate(model.avgMetrics)), key=lambda r: (-r[0], r[1]))
    table = df.sparkSession.createDataFrame(
        [(rank, ", ".join(f"{p.name}={v}" for p, v in sorted(maps[i].items(), key=lambda x: x[0].name)), v)
         for rank, (v, i) in enumerate(rows, 1)], f"rank int, params string, {metric}_mean double")
    return model, table
