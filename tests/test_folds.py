"""Shared fold preparation against pipelines fitted fold by fold, and the tuning layer."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tessera.operators import experiment as EX
from tessera.operators import folds as FO
from tessera.operators import metrics as MT
from tessera.operators import model as MD
from tessera.operators import sample as SA


def table(spark, n=1500):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x, z = rng.gauss(5, 2), rng.gauss(0, 1)
        rows.append((i, x if i % 11 else None, z if i % 13 else float("nan"), 3.0, int(rng.random() < 1 / (1 + 2.718 ** -(x - 5 + z))), i * 7 % 5))
    return spark.createDataFrame(rows, "id long, x double, z double, flat double, label int, fold int").repartition(3)


@pytest.mark.parametrize("kw", [{}, {"scaling": "robust"}, {"scaling": None}, {"scale_columns": ["z"]}, {"reducer": {"method": "lda"}}])
def test_same_folds_as_one_by_one(spark, kw):
    df = table(spark).persist()
    pipe = MD.build_pipeline("logistic", ["x", "z", "flat"], {"C": 1.0}, **kw)
    fast = {r.id: r.score for r in MD.cross_validate(pipe, df, "id")[1].collect()}
    pipe.shared_preparation = None
    slow = {r.id: r.score for r in MD.cross_validate(pipe, df, "id")[1].collect()}
    df.unpersist()
    assert set(fast) == set(slow) and len(fast) == 1500
    assert max(abs(fast[i] - slow[i]) for i in fast) < 5e-3


def test_search_prepares_once_and_releases(spark):
    spark.catalog.clearCache()
    df = table(spark)
    tables = []
    made = FO._statistics
    FO._statistics = lambda *a: (tables.append(a[3]), made(*a))[1]
    try:
        out = MD.grid_search("decision_tree", {"max_depth": [2, 3, 4]}, df, ["x", "z"], "id", parallelism=2)
    finally:
        FO._statistics = made
    assert out.count() == 3 and len(tables) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_column_without_values_is_refused(spark):
    with pytest.raises(ValueError):
        MD.cross_validate(MD.build_pipeline("logistic", ["x", "gone"], {}), table(spark).withColumn("gone", F.lit(None).cast("double")), "id")


def test_evaluator_and_tuning_by_f1(spark):
    df = table(spark)
    pipe = MD.build_pipeline("decision_tree", ["x", "z"], {})
    model, ranking = FO.tune(pipe, {"maxDepth": [1, 3]}, df, "f1")
    rows = ranking.orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2] and rows[0].f1_mean >= rows[1].f1_mean
    want = {}
    for depth in (1, 3):  # the same folds by hand
        values = []
        for f in range(5):
            m = Pipeline(stages=[*pipe.getStages()[:-1], pipe.getStages()[-1].copy({pipe.getStages()[-1].maxDepth: depth})]).fit(df.where(F.col("fold") != f))
            p = m.transform(df.where(F.col("fold") == f)).select("label", F.col("prediction").cast("int").alias("p"))
            values.append(MT.binary_metrics(p, "label", "p").first()["f1"])
        want[f"maxDepth={depth}"] = sum(values) / 5
    assert {r.params: pytest.approx(r.f1_mean) for r in rows} == want
    assert model.bestModel.stages[-1].getMaxDepth() == int(rows[0].params[-1])
    p = model.transform(df)
    auc = FO.BinaryEvaluator("roc_auc").evaluate(p)
    assert 0.5 < auc <= 1 and FO.BinaryEvaluator("accuracy").evaluate(p) > 0.5
    with pytest.raises(ValueError):
        FO.BinaryEvaluator("mse")


def test_training_rows_lie_in_even_partitions(spark):
    n, cores = 90_000, spark.sparkContext.defaultParallelism
    df = spark.range(0, n, 1, 60).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") % 13).cast("double").alias("x"))
    train, test, kept = EX.kept_parts(df, "label", "id")
    assert train.count() + test.count() == n and train.rdd.getNumPartitions() == cores
    tables = FO.FoldTables(train, "id", "label", "fold")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    a, b = tables.fold(FO.FoldSpec(("x",), (), "standard"), 0, "v")
    assert a.count() + b.count() == train.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # a kept table is not copied
    tables.release()
    train.unpersist()
    kept.unpersist()
    assert SA.evenly(df.limit(100), "id", 100).rdd.getNumPartitions() == 1
