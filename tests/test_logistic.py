"""Logistic fits that go on together, and metrics of many scorers, against single ones."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as MT
from tessera.operators import model as MD


def table(spark, n=900):
    x = F.sin(F.col("id") * 1.7)
    z = F.when(F.col("id") % 7 != 0, F.cos(F.col("id") * 0.9) * 40 + 100)
    return spark.range(0, n, 1, 3).select(
        "id", x.alias("x"), z.alias("z"), (F.col("id") % 11).cast("double").alias("v"), F.lit(2.0).alias("same"),
        (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 3 + 1).cast("double").alias("weight"),
        F.when(x + F.cos(F.col("id") * 0.9) + F.sin(F.col("id") * 12.9898) > 0.8, 1).otherwise(0).alias("label"))


@pytest.mark.parametrize("params,kw", [
    ({"C": 1.0}, {}),
    ({"C": 1e-3}, {"reducer": {"method": "lda"}}),
    ({"C": 0.01}, {"reducer": {"method": "pca", "n_components": 2}}),
    ({"regParam": 0.05, "standardization": True, "max_iter": 5}, {"scaling": None}),
])
def test_folds_fitted_together_score_as_single_fits(spark, monkeypatch, params, kw):
    df = table(spark).persist()
    pipe = MD.build_pipeline("logistic", ["x", "z", "v", "same"], params, "label", "weight", **kw)
    metrics, oof = MD.cross_validate(pipe, df, "id")
    got = {r.id: (r.score, r.prediction, r.fold, r.label) for r in oof.collect()}
    monkeypatch.setattr(MD, "logistic_plan", lambda *a: None)
    _, single = MD.cross_validate(pipe, df, "id")
    want = {r.id: (r.score, r.prediction, r.fold, r.label) for r in single.collect()}
    assert got.keys() == want.keys() and len(want) == 900
    for k, (score, *rest) in want.items():
        assert got[k][0] == pytest.approx(score, abs=1e-9) and list(got[k][1:]) == rest
    assert metrics.count() == 5
    for d in (oof, single, df):
        d.unpersist()


def test_search_runs_its_trials_together(spark, monkeypatch):
    """Every trial is fitted in every fold, but not by a chain of jobs of its own."""
    df = table(spark).persist()
    space = {"C": ("log", 1e-3, 10.0), "reducer_method": ("cat", ["none", "pca", "lda"]), "reducer_n": ("int", 2, 5)}
    chains = []
    fit = MD.fit_pipeline
    monkeypatch.setattr(MD, "fit_pipeline", lambda *a: (chains.append(1), fit(*a))[1])

    def search():
        res = MD.random_search("logistic", space, 5, df, ["x", "z", "v", "same"], "id", weight_col="weight", seed=1, baseline_auc=0.5)
        return {r.trial: r for r in res.collect()}
    got = search()
    failing = [p for p in MD.sample_space(space, 5, 1) if p["reducer_method"] == "pca" and p["reducer_n"] > 4]
    assert len(chains) <= 5 * len(failing)
    monkeypatch.setattr(MD, "logistic_plan", lambda *a: None)
    want = search()
    assert got.keys() == want.keys() == set(range(5))
    for i, r in want.items():
        assert got[i].params == r.params and got[i].beats_baseline == r.beats_baseline
        assert got[i].cv_roc_auc_mean == pytest.approx(r.cv_roc_auc_mean, abs=1e-9)
    df.unpersist()


def test_one_label_outside_a_fold_goes_to_single_fits(spark):
    df = table(spark, 60).withColumn("label", (F.col("fold") == 0).cast("int"))
    _, oof = MD.cross_validate(MD.build_pipeline("logistic", ["x", "v"], {}, "label", "weight"), df, "id")
    assert oof.count() == 60 and {r.score for r in oof.where("fold = 0").collect()} == {0.0}


def test_many_scorers_count_as_single_ones(spark):
    nan = float("nan")
    rows = [(i, i % 2, [1, 0, None, 1, 0][i % 5], [math.sin(i), None if i % 4 == 0 else (i % 3) / 2.0, nan if i % 6 == 0 else i % 10 / 10.0])
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, y int, s array<double>").repartition(3)
    df = df.withColumn("p", F.transform("s", lambda s: F.when(s > 0.25, 1).when(s.isNotNull(), 0)))
    for bucket in (1 << 20, 50):
        got = {(r.slot, r.g): r for r in MT.slot_metrics(df, "y", "s", 3, "p", by=["g"], rows_per_bucket=bucket).collect()}
        for k in range(3):
            one = df.select("g", "y", F.col("s")[k].alias("s"), F.col("p")[k].alias("p"))
            for r in MT.binary_metrics(one, "y", "p", "s", by=["g"]).collect():
                assert {m: got[k, r.g][m] for m in ("n", *MT.METRICS)} == {m: r[m] for m in ("n", *MT.METRICS)}
        assert len(got) == 6
    cut = {r.slot: r for r in MT.slot_metrics(df, "y", "s", 3, threshold=0.25).collect()}
    one = df.select("y", F.col("s")[1].alias("s"), F.when(F.col("s")[1] >= 0.25, 1).otherwise(0).alias("p"))
    r = MT.binary_metrics(one, "y", "p", "s").first()
    assert cut[1]["n"] == r["n"] and cut[1]["f1"] == r["f1"] and cut[1]["recall"] == r["recall"]
