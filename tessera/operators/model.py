"""Model arena on Spark ML (ML-*, CV-*, SC-1).

* Pipelines are ``pyspark.ml.Pipeline``: median ``Imputer`` -> ``VectorAssembler``
  -> scaler -> optional reducer (PCA or a Fisher direction) -> classifier.
  Every trainer is distributed; fitted state (medians, means, coefficients,
  trees) is small.
* Cross-validation uses an explicit ``fold`` column (stratified, hash based,
  :func:`tessera.operators.sample.stratified_folds`), so folds are the same
  for every model and independent of partitioning.  The out-of-fold
  predictions of all folds are one DataFrame; fold metrics are ONE grouped
  aggregate over it (AUC partitioned by fold).
* Searches evaluate parameter maps from a driver thread pool
  (``parallelism``): each candidate is a set of distributed fits.  Logistic
  candidates go on together, one job a step (:mod:`tessera.operators.logistic`).
* The soft vote reuses the out-of-fold probabilities computed once per base
  model; every weight vector is evaluated in the same job, next to each row.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Callable, Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.errors import IllegalArgumentException
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import decide, risk_factors
from tessera.operators import boosting as BT
from tessera.operators import gram as GR
from tessera.operators import lloyd as LL
from tessera.operators import logistic as LG
from tessera.operators import metrics as MT
from tessera.operators import permute as PM
from tessera.operators import sample as SA
from tessera.operators.folds import FoldSpec, FoldTables
from tessera.operators.vote import VoteModel, positive_score  # noqa: F401

# ----------------------------------------------------------------- registry --

# Estimator defaults of the reference policy (rounds, trees,
# perceptron iterations / tolerance, tree depth).
MODEL_REGISTRY: dict[str, tuple[type, dict]] = {
    "logistic": (LogisticRegression, {"maxIter": 100, "standardization": False}),
    "random_forest": (RandomForestClassifier, {"numTrees": 100, "featureSubsetStrategy": "sqrt"}),
    "gbt": (GBTClassifier, {"maxIter": 100}),
    "linear_svc": (LinearSVC, {"maxIter": 1000, "tol": 1e-3}),
    "decision_tree": (DecisionTreeClassifier, {"maxDepth": 4}),
}
HAS_PROBABILITY = {"logistic", "random_forest", "gbt", "decision_tree"}


def translate_params(model: str, params: Mapping, n_train: float | None = None) -> dict:
    """Reference-style hyper-parameter names -> Spark params.

    * ``C`` (inverse L2 strength on the summed loss) -> ``regParam = 1/(C n)``
      because Spark averages the loss over the (weighted) rows;
    * ``min_samples_split`` has no twin -> ``minInstancesPerNode = ceil(s/2)``;
    * ``num_leaves`` -> ``maxDepth = ceil(log2(leaves))``;
    * ``ccp_alpha`` has no twin and is dropped; ``criterion`` -> ``impurity``.
    """
    out = {}
    for k, v in params.items():
        if k == "C":
            out["regParam"] = 1.0 / (float(v) * float(n_train or 1.0))
        elif k in ("max_iter", "n_estimators"):
            out["numTrees" if model == "random_forest" else "maxIter"] = int(v)
        elif k == "max_depth":
            out["maxDepth"] = int(v)
        elif k == "min_samples_split":
            out["minInstancesPerNode"] = int(math.ceil(int(v) / 2))
        elif k == "min_samples_leaf":
            out["minInstancesPerNode"] = int(v)
        elif k == "num_leaves":
            out["maxDepth"] = int(math.ceil(math.log2(max(2, int(v)))))
        elif k == "learning_rate":
            out["stepSize"] = float(v)
        elif k == "criterion":
            out["impurity"] = "entropy" if v in ("entropy", "log_loss") else "gini"
        elif k == "tol":
            out["tol"] = float(v)
        elif k == "ccp_alpha":
            continue
        else:
            out[k] = v
    return out


# ------------------------------------------------------------ Fisher (ML-12) --

class _FisherParams(HasInputCol, HasOutputCol, HasLabelCol):
    weights = Param(Params._dummy(), "weights", "projection direction", TypeConverters.toListFloat)
    center = Param(Params._dummy(), "center", "overall mean", TypeConverters.toListFloat)


class FisherDirectionModel(Model, _FisherParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        w = self.getOrDefault(self.weights)
        mu = self.getOrDefault(self.center)
        x = vector_to_array(F.col(self.getInputCol()))
        # explicit dot product: plain arithmetic stays in generated code
        # (a zip_with / aggregate lambda would be interpreted per row)
        dot = reduce(lambda a, b: a + b, [x[i] * F.lit(float(a)) for i, a in enumerate(w) if a != 0.0],
                     F.lit(0.0))
        proj = dot - F.lit(float(np.dot(w, mu)))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(proj)))


def fisher_solution(rows: Sequence[tuple[int, np.ndarray]], sw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction, overall mean) from each class's number and mean and the pooled
    within-class products."""
    n_tot = sum(n for n, _ in rows)
    mu = sum(n * mean for n, mean in rows) / n_tot
    sb = sum(n * np.outer(mean - mu, mean - mu) for n, mean in rows)
    vals, vecs = np.linalg.eig(np.linalg.pinv(sw) @ sb)
    w = np.real(vecs[:, int(np.argmax(np.real(vals)))])
    pooled = sw / max(1, n_tot - len(rows))
    scale = math.sqrt(max(float(w @ pooled @ w), 1e-300))
    w = w / scale
    nz = np.flatnonzero(np.abs(w) > 1e-12)
    return (-w if nz.size and w[nz[0]] < 0 else w), mu


class FisherDirection(Estimator, _FisherParams, DefaultParamsReadable, DefaultParamsWritable):
    """ML-12: supervised 1-component reducer (Fisher's linear discriminant).

    Fit = one pass that adds up block-wise moments per class (``gram``), of which
    the means of the classes and one pooled d x d matrix reach the driver, then an
    eigen-solve there.
    ``lda_0 = (x - mean) . w``, with ``w`` scaled to unit pooled within-class
    variance."""

    def __init__(self, inputCol="features", outputCol="lda", labelCol="label"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, labelCol=labelCol)

    def _fit(self, df: DataFrame) -> FisherDirectionModel:
        col, lab = self.getInputCol(), self.getLabelCol()
        within, means = GR.class_scatter(df, vector_to_array(F.col(col)), F.col(lab), keep=True)
        per_class: dict = {}
        for r in means.collect():
            per_class.setdefault(r["label"], []).append((r["i"], r["n"], r["mean"]))
        cells = within.collect()
        GR.release(means)
        rows = [(c[0][1], np.array([mean for _, _, mean in sorted(c)])) for c in per_class.values()]
        d = len(rows[0][1])
        sw = np.zeros((d, d))
        for r in cells:
            sw[r["i"], r["j"]] = sw[r["j"], r["i"]] = r["within"]
        w, mu = fisher_solution(rows, sw)
        m = FisherDirectionModel()
        m._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), labelCol=self.getLabelCol(),
               weights=[float(v) for v in w], center=[float(v) for v in mu])
        return m


# ------------------------------------------------- categorical branch (FE-9) --

class _ColsParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "input columns", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "fill values", TypeConverters.toListString)


class ModeImputerModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.inputCols)
        fills = self.getOrDefault(self.fills)
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v))
                               for c, v in zip(cols, fills) if v is not None})


class ModeImputer(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """IS-3 as a pipeline stage for string columns: most frequent value,
    smallest on ties (one grouped count + top-1 per column)."""

    def __init__(self, inputCols=None):
        super().__init__()
        self._set(inputCols=list(inputCols or []))

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        from tessera.operators.impute import fit_modes
        cols = self.getOrDefault(self.inputCols)
        modes = fit_modes(df.select(*[F.col(c).cast("string").alias(c) for c in cols]), cols)
        m = ModeImputerModel()
        m._set(inputCols=cols, fills=[modes[c] for c in cols])
        return m


class DropFirst(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Remove component 0 of a one-hot vector (sklearn ``drop='first'``);
    Spark's ``dropLast`` drops the last category instead.  Built-in array
    expressions, no UDF."""

    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        a = vector_to_array(F.col(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.slice(a, 2, F.size(a) - 1)))


def categorical_stages(cols: Sequence[str], drop_first: bool = True) -> tuple[list, list[str]]:
    """FE-9 / IS-8 categorical branch: mode imputation -> ``StringIndexer``
    (alphabetical, unknown kept in an extra slot) -> ``OneHotEncoder`` whose
    dropped last slot is that unknown slot (unknown -> all zeros) -> optional
    drop of the first category.  Returns (stages, output vector columns)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = [f"{c}__idx" for c in cols]
    oh = [f"{c}__oh" for c in cols]
    stages = [ModeImputer(inputCols=list(cols)),
              StringIndexer(inputCols=list(cols), outputCols=idx, handleInvalid="keep",
                            stringOrderType="alphabetAsc"),
              # the indexer already reserves the last slot for unknown values; the
              # encoder drops exactly that slot, so unknown -> all zeros
              OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True, handleInvalid="error")]
    if not drop_first:
        return stages, oh
    out = [f"{c}__ohd" for c in cols]
    stages += [DropFirst(inputCol=o, outputCol=d) for o, d in zip(oh, out)]
    return stages, out


# ---------------------------------------------------------------- pipelines --

def build_pipeline(model: str, features: Sequence[str], params: Mapping | None = None,
                   label: str = "label", weight_col: str | None = None, scaling: str | None = "standard",
                   reducer: Mapping | None = None, seed: int = 42, n_train: float | None = None,
                   categorical: Sequence[str] = (), drop_first: bool = True,
                   scale_columns: Sequence[str] | None = None) -> Pipeline:
    """ML-1 / IS-8: numeric branch (median imputation -> assembly ->
    scaling of ``scale_columns``, all features by default; the others follow
    unscaled) in parallel with the categorical branch of
    :func:`categorical_stages`, concatenated, -> reducer -> estimator (class
    from the allow-list registry, defaults + overrides, seed injected where
    supported)."""
    cls, defaults = MODEL_REGISTRY[model]
    scaled = list(features) if scale_columns is None else [c for c in features if c in set(scale_columns)]
    plain = [c for c in features if c not in set(scaled)]
    features = scaled + plain if scaling in ("standard", "robust") else list(features)
    if not scaled:
        scaling = None
    if scaling not in ("standard", "robust"):
        scaled, plain = list(features), []
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=[f"{c}__imp" for c in features],
                      relativeError=1e-4),
              VectorAssembler(inputCols=[f"{c}__imp" for c in scaled], outputCol="_x_raw", handleInvalid="keep")]
    cur = "_x_raw"
    if scaling == "standard":
        stages.append(StandardScaler(inputCol=cur, outputCol="_x_scaled", withMean=True, withStd=True))
        cur = "_x_scaled"
    elif scaling == "robust":
        stages.append(RobustScaler(inputCol=cur, outputCol="_x_scaled", withCentering=True, withScaling=True))
        cur = "_x_scaled"
    if plain:
        stages.append(VectorAssembler(inputCols=[cur, *[f"{c}__imp" for c in plain]], outputCol="_x_num",
                                      handleInvalid="keep"))
        cur = "_x_num"
    if categorical:
        cat_stages, cat_out = categorical_stages(categorical, drop_first)
        stages += cat_stages
        stages.append(VectorAssembler(inputCols=[cur, *cat_out], outputCol="_x_all"))
        cur = "_x_all"
    shared = None if categorical else (len(stages), cur, FoldSpec(tuple(scaled), tuple(plain), scaling))
    method = (reducer or {}).get("method", "none")
    if method == "pca":
        stages.append(PCA(k=int(reducer.get("n_components", 2)), inputCol=cur, outputCol="_x_red"))
        cur = "_x_red"
    elif method == "lda":
        stages.append(FisherDirection(inputCol=cur, outputCol="_x_red", labelCol=label))
        cur = "_x_red"
    est = cls()
    kw = dict(defaults)
    kw.update(translate_params(model, params or {}, n_train))
    kw.update(featuresCol=cur, labelCol=label)
    if weight_col and est.hasParam("weightCol"):
        kw["weightCol"] = weight_col
    if est.hasParam("seed"):
        kw["seed"] = seed
    est.setParams(**{k: v for k, v in kw.items() if est.hasParam(k)})
    stages.append(est)
    pipe = Pipeline(stages=stages)
    pipe.shared_preparation = shared
    if "C" in (params or {}) and est.hasParam("regParam"):
        pipe.inverse_strength = float(params["C"])
    return pipe


def fit_pipeline(pipe: Pipeline, df: DataFrame, n: int | None = None) -> PipelineModel:
    """Fit; a pipeline built with ``C`` gets ``regParam = 1 / (C n)`` for the n
    rows it is fitted on, so that a fold and the refit share one penalty."""
    c = getattr(pipe, "inverse_strength", None)
    if c is None:
        return pipe.fit(df)
    *stages, est = pipe.getStages()
    n = df.count() if n is None else n
    return Pipeline(stages=[*stages, est.copy({est.regParam: 1.0 / (c * max(1, n))})]).fit(df)


# -------------------------------------------------------- cross-validation --

def _persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def small(df: DataFrame) -> DataFrame:
    """A result table (one row per model, fold or weight vector) computed now,
    so that what it was computed from can be released."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def logistic_plan(pipe: Pipeline, label: str) -> LG.Plan | None:
    """What :mod:`logistic` is to fit, if it can: a binomial logistic regression with L2
    penalty on the shared preparation, its components or its Fisher direction."""
    if not getattr(pipe, "shared_preparation", None):
        return None
    skip, _, spec = pipe.shared_preparation
    *reducers, est = pipe.getStages()[skip:]
    if type(est) is not LogisticRegression or len(reducers) > 1:
        return None
    reducer, k = "none", 0
    for r in reducers:
        if isinstance(r, PCA):
            reducer, k = "pca", r.getK()
        elif isinstance(r, FisherDirection) and r.getLabelCol() == label:
            reducer = "lda"
        else:
            return None
    get = est.getOrDefault
    bounds = (est.lowerBoundsOnCoefficients, est.upperBoundsOnCoefficients, est.lowerBoundsOnIntercepts, est.upperBoundsOnIntercepts)
    plain = get(est.elasticNetParam) == 0 and get(est.fitIntercept) and get(est.family) in ("auto", "binomial") \
        and get(est.threshold) == 0.5 and not est.isDefined(est.thresholds) and not any(est.isSet(b) for b in bounds)
    weight = get(est.weightCol) if est.isDefined(est.weightCol) and get(est.weightCol) else None
    if not plain or k > len(spec.scaled) + len(spec.plain) or weight not in (None, "weight"):
        return None
    return LG.Plan(reducer, k, getattr(pipe, "inverse_strength", None), get(est.regParam), get(est.standardization),
                   get(est.maxIter), get(est.tol), weight)


def _logistic_folds(pipe: Pipeline, tables: FoldTables, folds: Sequence) -> DataFrame | None:
    """Held-out scores of all folds' fits, made together; None for other pipelines."""
    plan = logistic_plan(pipe, tables.label)
    if plan is None or plan.weight and plan.weight not in tables.df.columns:
        return None
    spec = pipe.shared_preparation[2]
    fits = LG.fit_all(tables, spec, [plan], fisher_solution, folds)
    if fits is None:
        return None
    d = LG.scored(tables, spec, fits, 1, folds)
    return d.withColumns({"score": F.col("scores")[0], "prediction": F.col("predictions")[0]}).drop("scores", "predictions")


def boosting_plan(pipe: Pipeline) -> BT.Plan | None:
    """What :mod:`boosting` is to fit, if it can: boosted trees on the shared preparation
    that see all rows and features."""
    if not getattr(pipe, "shared_preparation", None) or len(pipe.getStages()) != pipe.shared_preparation[0] + 1:
        return None
    est = pipe.getStages()[-1]
    if type(est) is not GBTClassifier:
        return None
    get = est.getOrDefault
    weight = get(est.weightCol) if est.isDefined(est.weightCol) and get(est.weightCol) else None
    plain = get(est.subsamplingRate) == 1.0 and get(est.featureSubsetStrategy) in ("all", "auto") and get(est.minInstancesPerNode) == 1 \
        and get(est.minWeightFractionPerNode) == 0.0 and not est.isDefined(est.thresholds) and not est.isDefined(est.validationIndicatorCol) \
        and 1 <= get(est.maxDepth) <= BT.DEEPEST and get(est.maxBins) <= BT.BINS and weight in (None, "weight")
    return BT.Plan(get(est.maxIter), get(est.maxDepth), get(est.stepSize), get(est.maxBins), get(est.minInfoGain),
                   weight, get(est.seed)) if plain else None


def _boosted_folds(pipe: Pipeline, tables: FoldTables, folds: Sequence) -> DataFrame | None:
    """Held-out scores of all folds' boosted trees, grown together; None for other pipelines."""
    plan = boosting_plan(pipe)
    if plan is None or plan.weight and plan.weight not in tables.df.columns:
        return None
    spec = pipe.shared_preparation[2]
    fits = BT.fit_all(tables, spec, plan, folds)
    return None if fits is None else BT.scored(tables, spec, fits)


def cross_validate(pipeline: Pipeline, df: DataFrame, key: str, label: str = "label",
                   fold_col: str = "fold", name: str = "model", parallelism: int = 5,
                   folds: Sequence[int] | None = None, tables: FoldTables | None = None) -> tuple[DataFrame, DataFrame]:
    """CV-1: fit on the other folds, predict the held-out fold, for every
    fold.  Returns (fold metrics, out-of-fold predictions ``key, fold,
    label, score, prediction``).  Stages are fitted on training rows only.

    The imputation and scaling of pipelines from :func:`build_pipeline` without a
    categorical branch are not refitted per fold: :class:`FoldTables` learns them
    for all folds at once and holds the vectors.  A search hands one to all its
    candidates through ``tables``.  Logistic fits and boosted trees of all folds go on
    together (:mod:`logistic`, :mod:`boosting`)."""
    owned = tables is None
    tables = tables or FoldTables(df, key, label, fold_col)
    sizes = tables.sizes
    folds = folds if folds is not None else sorted(sizes)
    shared = getattr(pipeline, "shared_preparation", None)
    together = _logistic_folds(pipeline, tables, folds)
    if together is None:
        together = _boosted_folds(pipeline, tables, folds)

    def one(f):
        n = sum(sizes.values()) - sizes[f]
        if shared:
            skip, column, spec = shared
            rest = Pipeline(stages=pipeline.getStages()[skip:])
            if hasattr(pipeline, "inverse_strength"):
                rest.inverse_strength = pipeline.inverse_strength
            train, held = tables.fold(spec, f, column)
            p = fit_pipeline(rest, train, n).transform(held)
        else:
            p = fit_pipeline(pipeline, df.where(F.col(fold_col) != f), n).transform(df.where(F.col(fold_col) == f))
        return p.select(key, fold_col, F.col(label).cast("int").alias("label"),
                        positive_score(p).alias("score"), F.col("prediction").cast("int").alias("prediction"))
    if together is None:
        with ThreadPoolExecutor(max(1, parallelism)) as ex:
            parts = list(ex.map(one, folds))
        oof = reduce(lambda a, b: a.unionByName(b), parts)
    else:
        oof = together.select(key, fold_col, "label", "score", "prediction")
    # the OOF table feeds several metric jobs (and the soft vote): keep it
    oof = _persist(oof)
    metrics = MT.binary_metrics(oof, "label", "prediction", "score", by=[fold_col]) \
        .withColumn("model", F.lit(name))
    if owned and tables.learnt:
        metrics = small(metrics)  # fills the predictions' cache, then the vectors can go
        tables.release()
    return metrics, oof


def arena(models: Mapping[str, Pipeline], df: DataFrame, key: str, label: str = "label",
          fold_col: str = "fold", parallelism: int = 2, fold_parallelism: int = 5) -> tuple[DataFrame, dict]:
    """CV-2: CV of every model (``parallelism`` models at a time, each with
    ``fold_parallelism`` concurrent fold fits); returns (ranking table,
    {name: oof})."""
    owned = not df.is_cached
    df = _persist(df)
    tables = FoldTables(df, key, label, fold_col)

    def one(item):
        name, pipe = item
        return name, cross_validate(pipe, df, key, label, fold_col, name, fold_parallelism, tables=tables)
    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        done = list(ex.map(one, list(models.items())))
    fold_metrics = small(reduce(lambda a, b: a.unionByName(b), [m for _, (m, _) in done]))
    tables.release()
    if owned:
        df.unpersist()
    oofs = {name: oof for name, (_, oof) in done}  # the caller releases them
    ranking = SA.rank_models(MT.aggregate_folds(fold_metrics, by=["model"]), "cv_roc_auc_mean")
    return ranking, oofs


def select_best(results: DataFrame, metric: str = "cv_roc_auc_mean") -> DataFrame:
    """CV-6: the best row by ``metric`` (ties by model name)."""
    return results.orderBy(F.desc_nulls_last(metric), F.asc("model")).limit(1)


def _evaluate_candidates(make: Callable[[dict], Pipeline], candidates: Sequence[dict], df: DataFrame,
                         key: str, label: str, fold_col: str, name: str, parallelism: int) -> DataFrame:
    owned = not df.is_cached
    df = _persist(df)  # released below; the trials' results are tables of one row
    tables = FoldTables(df, key, label, fold_col)

    pipes: dict = {}
    for i, params in enumerate(candidates):
        try:
            pipe = make(params)
            plan = logistic_plan(pipe, label)
        except (ValueError, TypeError, IllegalArgumentException):  # told by one()
            continue
        if plan and (not plan.weight or plan.weight in df.columns):
            pipes.setdefault((pipe.shared_preparation[2], plan.weight), {})[i] = plan
    together = {}
    for (spec, _), plans in pipes.items():
        fits = LG.fit_all(tables, spec, list(plans.values()), fisher_solution)
        if fits is not None:
            d = LG.scored(tables, spec, fits, len(plans))
            m = MT.slot_metrics(d, "label", "scores", len(plans), "predictions", by=[fold_col], n=sum(tables.sizes.values()))
            agg = MT.aggregate_folds(m, by=["slot"])
            numbers = list(plans)
            together |= {numbers[r["slot"]]: (name, *r[1:]) for r in agg.collect()}
            schema = agg.drop("slot").schema

    def one(i_params):
        i, params = i_params
        try:
            m, oof = cross_validate(make(params), df, key, label, fold_col, name, tables=tables)
            agg = small(MT.aggregate_folds(m, by=["model"]))
            oof.unpersist()
            return agg.withColumn("trial", F.lit(i)).withColumn("params", F.lit(json.dumps(params, sort_keys=True)))
        except (ValueError, TypeError, IllegalArgumentException) as e:  # parameters that do not fit score 0
            spark = df.sparkSession
            return spark.createDataFrame([(name, i, json.dumps(params, sort_keys=True), 0.0, str(e)[:200])],
                                         "model string, trial int, params string, cv_roc_auc_mean double, error string")
    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        parts = list(ex.map(one, [(i, p) for i, p in enumerate(candidates) if i not in together]))
    tables.release()
    if together:
        rows = [(*r, i, json.dumps(candidates[i], sort_keys=True)) for i, r in sorted(together.items())]
        metrics = ", ".join(f"{c} double" for c in schema.names)
        parts.insert(0, df.sparkSession.createDataFrame(rows, f"model string, {metrics}, trial int, params string"))
    if owned:
        df.unpersist()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def grid_search(model: str, grid: Mapping[str, Sequence], df: DataFrame, features: Sequence[str], key: str,
                label: str = "label", fold_col: str = "fold", weight_col: str | None = None,
                parallelism: int = 1, **pipe_kw) -> DataFrame:
    """CV-3: exhaustive search; one row per combination with every CV metric."""
    names = list(grid)
    combos = [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]
    n = df.count()

    def make(p):
        return build_pipeline(model, features, p, label, weight_col, n_train=n, **pipe_kw)
    return _evaluate_candidates(make, combos, df, key, label, fold_col, model, parallelism)


def sample_space(space: Mapping[str, tuple], n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws from ``{name: ("int", lo, hi) | ("float", lo, hi) |
    ("log", lo, hi) | ("cat", [values])}``."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        p = {}
        for k, spec in space.items():
            kind = spec[0]
            if kind == "int":
                p[k] = rng.randint(spec[1], spec[2])
            elif kind == "float":
                p[k] = rng.uniform(spec[1], spec[2])
            elif kind == "log":
                p[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            elif kind == "cat":
                p[k] = rng.choice(list(spec[1]))
            else:
                raise ValueError(kind)
        out.append(p)
    return out


def random_search(model: str, space: Mapping[str, tuple], n_trials: int, df: DataFrame,
                  features: Sequence[str], key: str, label: str = "label", fold_col: str = "fold",
                  weight_col: str | None = None, seed: int = 42, parallelism: int = 1,
                  baseline_auc: float | None = None, **pipe_kw) -> DataFrame:
    """CV-4 (re-aimed Bayesian search): seeded random trials; the reducer
    may be searched jointly via ``reducer_method`` / ``reducer_n`` keys.
    Adds ``beats_baseline`` when ``baseline_auc`` is given."""
    n = df.count()

    def make(p):
        p = dict(p)
        method = p.pop("reducer_method", None)
        k = p.pop("reducer_n", 2)
        reducer = {"method": method, "n_components": k} if method and method != "none" else None
        kw = dict(pipe_kw)
        if reducer:
            kw["reducer"] = reducer
        return build_pipeline(model, features, p, label, weight_col, n_train=n, seed=seed, **kw)
    res = _evaluate_candidates(make, sample_space(space, n_trials, seed), df, key, label, fold_col, model,
                               parallelism)
    if baseline_auc is not None:
        res = res.withColumn("beats_baseline", F.col("cv_roc_auc_mean") > F.lit(baseline_auc))
    return res


def soft_vote(oofs: Mapping[str, DataFrame], key: str, weight_range: Sequence[int] = (1, 2, 3, 4, 5),
              threshold: float = 0.5, bins: int | None = None) -> DataFrame:
    """CV-5: weighted mean of the base models' out-of-fold probabilities.

    The OOF tables (one row per key) are joined once; all weight vectors are
    evaluated in ONE job: a row has its scores under all of them, and every task
    sends their sorted values (:func:`metrics.slot_metrics`).  Returns one row per weight
    vector with the aggregated CV metrics, best first; it is computed now, and the
    joined table is kept meanwhile.  With ``bins`` the AUCs come
    from score summaries: every task adds its rows to at most ``bins`` counts per
    weight vector and fold, and only these are shuffled."""
    names = list(oofs)
    base = None
    for i, n in enumerate(names):
        o = oofs[n].select(key, "fold", "label", F.col("score").alias(f"_p{i}"))
        base = o if base is None else base.join(o.drop("label"), on=[key, "fold"], how="inner")
    combos = list(itertools.product(weight_range, repeat=len(names)))
    base = _persist(base)
    wcols = [f"w_{n}" for n in names]
    score = [reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"_p{i}") for i, w in enumerate(c)])
             / reduce(lambda a, b: a + b, [F.lit(w) for w in c]) for c in combos]
    if bins is None:
        d = base.select("fold", "label", F.array(*score).alias("scores"))
        per_fold = MT.slot_metrics(d, "label", "scores", len(combos), threshold=threshold, by=["fold"])
        per_fold = per_fold.select("*", *[F.array(*[F.lit(c[i]) for c in combos])[F.col("slot")].alias(w) for i, w in enumerate(wcols)])
    else:
        grid = F.explode(F.array(*[F.struct(*[F.lit(w).alias(n) for n, w in zip(wcols, c)], s.alias("score"))
                                   for c, s in zip(combos, score)]))
        d = base.select("fold", "label", grid.alias("_w")).select("fold", "label", "_w.*")
        d = d.withColumn("prediction", decide("score", threshold))
        per_fold = MT.binary_metrics(d, "label", "prediction", "score", by=wcols + ["fold"], bins=bins)
    res = MT.aggregate_folds(per_fold, by=wcols)
    res = small(res.orderBy(F.desc("cv_roc_auc_mean"), *wcols))
    base.unpersist()
    return res


def holdout_evaluate(model, holdout: DataFrame, label: str = "label") -> DataFrame:
    """CV-7: metrics of a fitted model on unseen rows."""
    p = model.transform(holdout)
    p = p.select(F.col(label).cast("int").alias("label"), positive_score(p).alias("score"),
                 F.col("prediction").cast("int").alias("prediction"))
    return MT.binary_metrics(p, "label", "prediction", "score")


# ------------------------------------------------------------- diagnostics --

def assembler_names(model: PipelineModel) -> list[str]:
    """Names of the final feature vector's slots: numeric features, then one
    ``<col>=<category>`` per kept one-hot slot."""
    from pyspark.ml.feature import StringIndexerModel
    names: list[str] = []
    labels = {}
    drop_first = any(isinstance(st, DropFirst) for st in model.stages)
    for st in model.stages:
        if isinstance(st, StringIndexerModel):
            for c, lab in zip(st.getInputCols(), st.labelsArray):
                labels[c] = list(lab)
    for st in model.stages:
        if isinstance(st, VectorAssembler):  # scaled columns, then the others
            names += [c[:-5] for c in st.getInputCols() if c.endswith("__imp")]
    for c, lab in labels.items():
        names += [f"{c}={v}" for v in (lab[1:] if drop_first else lab)]
    if not names:
        raise ValueError("no VectorAssembler stage")
    return names


def linear_weights(model: PipelineModel) -> DataFrame:
    """ML-7: ``feature, weight`` sorted by |weight| plus the bias row."""
    est = model.stages[-1]
    names = assembler_names(model)
    coef = est.coefficients.toArray().tolist()
    if len(coef) != len(names):
        names = [f"component_{i}" for i in range(len(coef))]
    rows = [(n, float(w)) for n, w in zip(names, coef)] + [("(bias)", float(est.intercept))]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, weight double") \
        .orderBy(F.desc(F.abs("weight")), "feature")


def tree_rules(model: PipelineModel) -> DataFrame:
    """ML-8: the tree(s) as readable split rules, one line per row, with
    feature indices replaced by names."""
    est = model.stages[-1]
    names = assembler_names(model)
    text = est.toDebugString
    for i in sorted(range(len(names)), reverse=True):
        text = text.replace(f"feature {i} ", f"{names[i]} ")
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(i, ln) for i, ln in enumerate(text.splitlines())], "line int, rule string")


def feature_importance(model: PipelineModel, top: int | None = None, data: DataFrame | None = None,
                       key: str | None = None, label: str = "label") -> DataFrame:
    """ML-9: tree importances, else |coefficient|, else (with ``data`` and
    ``key``) permutation importance."""
    est = model.stages[-1]
    names = assembler_names(model)
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        vals = [abs(v) for v in est.coefficients.toArray().tolist()]
    elif data is not None and key is not None:
        feats = [n for n in names if "=" not in n]
        perm = permutation_importance(model, data, feats, key, label)
        perm = perm.select("feature", F.col("importance_mean").alias("importance"))
        return perm.limit(top) if top else perm
    else:
        raise ValueError("model has neither importances nor coefficients; pass data and key")
    if len(vals) != len(names):
        names = [f"component_{i}" for i in range(len(vals))]
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def permutation_importance(model: Model | Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], key: str,
                           label: str = "label", repeats: int = 5, seed: int = 42, rows_per_bucket: int = 1 << 20) -> DataFrame:
    """ML-10: mean and std of the AUC drop when one feature is shuffled,
    over ``repeats`` seeded permutations, on the whole evaluation table.

    ``model`` is a fitted classifier or a function that adds a column ``score``.
    Row positions are found once; all shuffles of all features are scored in one
    job and their exact AUCs are one grouped statistic (:mod:`tessera.operators.permute`).
    The shuffled rows move twice, to their values and to the bucket of their score;
    the buckets are those of the scores without a shuffle."""
    owned = not df.is_cached
    df = _persist(df)
    n = df.count()
    positions = _persist(SA.ordered_index(df, [key], name="_pos", rows_per_bucket=rows_per_bucket, n_rows=n))
    positions.count()
    if owned:
        df.unpersist()

    def scored(d: DataFrame, *more: str) -> DataFrame:
        if isinstance(model, Model):
            p = model.transform(d)
            p = p.withColumn("score", positive_score(p))
        else:
            p = model(d)
        return p.select(*more, F.col(label).cast("int").alias("y"), F.col("score").cast("double").alias("s"))
    copies = PM.shuffled_copies(df, features, key, repeats, seed, positions, n)
    auc = {r["_slot"]: r["roc_auc"] for r in MT.roc_auc(
        scored(copies, "_slot"), "s", "y", by=["_slot"], rows_per_bucket=rows_per_bucket, like=scored(positions),
        copies=len(features) * repeats + 1).collect()}
    positions.unpersist()
    rows = []
    for i, f in enumerate(features):
        drops = [auc.get(PM.AS_IS, 0.5) - auc.get(i * repeats + r, 0.5) for r in range(repeats)]
        rows.append((f, float(np.mean(drops)), float(np.std(drops, ddof=1)) if repeats > 1 else 0.0))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "feature string, importance_mean double, importance_std double") \
        .orderBy(F.desc("importance_mean"))


# --------------------------------------------------------- unsupervised --

def to_vector(df: DataFrame, cols: Sequence[str] | str, out: str = "_v") -> DataFrame:
    """Numeric columns or one array column -> ML vector column."""
    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.col(cols).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def standardize_vector(df: DataFrame, col: str = "_v", out: str = "_z", ddof: int = 0) -> DataFrame:
    """Column-wise (x - mean) / std with population std (sklearn); a zero std
    leaves the component centred."""
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors
    s = StandardScaler(inputCol=col, outputCol="_zs", withMean=True, withStd=True).fit(df)
    z = s.transform(df)
    if ddof == 0:
        # Spark scales by the sample std; rescale by sqrt(n / (n-1)) with a
        # JVM vector product
        n = df.count()
        f = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        d = len(s.mean)
        z = ElementwiseProduct(scalingVec=Vectors.dense([f] * d), inputCol="_zs", outputCol=out) \
            .transform(z).drop("_zs")
    else:
        z = z.withColumnRenamed("_zs", out)
    return z


def kmeans_scan(df: DataFrame, cols, ks: Sequence[int] = (2, 3, 4, 5, 6), n_init: int = 10,
                seed: int = 42, max_iter: int = 300) -> DataFrame:
    """ML-13: for each k the best of ``n_init`` seeded runs (lowest cost) on
    standardized complete rows: ``k, silhouette, inertia``.  All runs of all k go on
    together (:mod:`tessera.operators.lloyd`).  The silhouette is
    Spark's squared-Euclidean silhouette over ALL rows (the reference samples
    1000 rows with Euclidean distance)."""
    d = df.dropna(subset=list(cols)) if not isinstance(cols, str) else df.where(F.col(cols).isNotNull())
    z = _persist(standardize_vector(to_vector(d, cols)).select("_z"))
    z.count()  # the first centres are sought from several threads
    ev = ClusteringEvaluator(featuresCol="_z", predictionCol="_c", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    fits = LL.fit_all(z, "_z", [(k, seed + r) for k in ks for r in range(n_init)], max_iter)
    rows = []
    for k in ks:
        cost, centres = LL.best_of(fits, k)
        p = LL.assigned(z, "_z", centres, "_c")
        sil = ev.evaluate(p.select(array_to_vector("_x").alias("_z"), F.col("_c").cast("double").alias("_c")))
        rows.append((int(k), float(sil), cost))
    z.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double")


def assign_clusters(df: DataFrame, cols, key: str, k: int = 3, seed: int = 42, n_init: int = 10) -> DataFrame:
    """ML-14: ``key, cluster`` — a cluster for every complete row, null for
    rows with a missing input (no join: the two sides are unioned).  All restarts go
    on together (:mod:`tessera.operators.lloyd`)."""
    complete = df.dropna(subset=list(cols)) if not isinstance(cols, str) else df.where(F.col(cols).isNotNull())
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]) if not isinstance(cols, str) \
        else F.col(cols).isNull()
    incomplete = df.where(missing)
    z = _persist(standardize_vector(to_vector(complete, cols)).select(key, "_z"))
    z.count()
    _, centres = LL.best_of(LL.fit_all(z, "_z", [(k, seed + r) for r in range(n_init)]), k)
    z.unpersist()  # only the restarts read it again and again
    out = LL.assigned(z, "_z", centres, "cluster").select(key, "cluster")
    return out.unionByName(incomplete.select(key, F.lit(None).cast("int").alias("cluster")))


def pca_scores(df: DataFrame, cols, key: str, k: int = 2, prefix: str = "pc_") -> DataFrame:
    """ML-15 / ML-11: ``key, pc_0 .. pc_{k-1}`` of the standardized complete
    rows (Spark PCA does not centre; the input is centred by the scaler)."""
    d = df.dropna(subset=list(cols)) if not isinstance(cols, str) else df.where(F.col(cols).isNotNull())
    z = standardize_vector(to_vector(d, cols))
    m = PCA(k=k, inputCol="_z", outputCol="_pc").fit(z)
    arr = vector_to_array(F.col("_pc"))
    return m.transform(z).select(key, *[arr[i].alias(f"{prefix}{i}") for i in range(k)])


def fisher_projection(df: DataFrame, cols, label: str, key: str) -> DataFrame:
    """ML-12 stand-alone: ``key, label, lda_0``."""
    d = to_vector(df.where(F.col(label).isNotNull()), cols)
    m = FisherDirection(inputCol="_v", outputCol="_l", labelCol=label).fit(d)
    return m.transform(d).select(key, label, vector_to_array(F.col("_l"))[0].alias("lda_0"))


# ----------------------------------------------------------------- scoring --

def score(model: PipelineModel, df: DataFrame, threshold: float = 0.30, strict: bool = False,
          rules: Sequence[tuple[str, Column]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """SC-1: positive-class probability, triage decision and matched rule
    messages for every row of a table."""
    p = model.transform(df)
    prob = positive_score(p)
    cols = [*keep, prob.alias("probability"), decide(prob, threshold, strict).alias("decision")]
    if rules:
        cols.append(F.array_join(risk_factors(rules), "|").alias("factors"))
    return p.select(*cols)
