"""Score summaries: the error bound holds, parts add up, the vote can use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as MT
from tessera.operators import model as MD


def _scored(spark, n=4000, seed=1):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    s = np.clip(r.beta(2, 3, n) + 0.1 * y, 0, 1.2).round(3)
    rows = [(int(i), int(i % 3), float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))]
    return spark.createDataFrame(rows, "id long, g int, s double, y int").repartition(6)


@pytest.mark.parametrize("bins", [1, 2, 7, 64, 4096])
def test_exact_auc_lies_within_the_bound(spark, bins):
    # scores above 1 share the last bin, so even there the bound must hold
    df = _scored(spark)
    exact = {r.g: r.roc_auc for r in MT.roc_auc(df, "s", "y", ["g"]).collect()}
    got = MT.summary_auc(MT.score_summary(df, "s", "y", ["g"], bins), ["g"]).collect()
    assert len(got) == 3
    for r in got:
        assert abs(r.roc_auc - exact[r.g]) <= r.max_error + 1e-12
        assert r.max_error <= (0.5 if bins == 1 else 0.3)
    if bins == 1:
        assert all(r.roc_auc == 0.5 and r.max_error == 0.5 for r in got)


def test_summaries_of_parts_add_up(spark):
    df = _scored(spark)
    parts = [MT.score_summary(df.where(f"g = {g}"), "s", "y", bins=128) for g in range(3)]
    whole = MT.score_summary(df, "s", "y", bins=128)
    assert sorted(MT.merge_summaries(parts).collect()) == sorted(whole.collect())
    assert whole.count() <= 128


def test_nulls_one_class_nan_and_empty(spark):
    rows = [(None, 1), (0.4, None), (float("nan"), 1), (-3.0, 0), (0.9999999999999999, 0), (5.0, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert sorted(tuple(r) for r in MT.score_summary(df, "s", "y", bins=10).collect()) == [(0, 0, 1), (9, 2, 1)]
    one = MT.summary_auc(MT.score_summary(df.where("y = 1"), "s", "y")).first()
    assert (one.roc_auc, one.max_error) == (0.5, 0.0)
    none = MT.summary_auc(MT.score_summary(df.where("false"), "s", "y")).first()
    assert (none.roc_auc, none.max_error) == (0.5, 0.0)


def test_vote_from_summaries_is_near_the_exact_one(spark):
    df = _scored(spark).selectExpr("id", "g AS fold", "y AS label", "least(s, 1.0) AS score")
    other = df.selectExpr("id", "fold", "label", "1 - score * score AS score")
    exact = MD.soft_vote({"a": df, "b": other}, "id", (1, 2)).collect()
    near = {(r.w_a, r.w_b): r for r in MD.soft_vote({"a": df, "b": other}, "id", (1, 2), bins=4096).collect()}
    assert len(near) == len(exact) == 4
    for r in exact:
        n = near[r.w_a, r.w_b]
        assert n.cv_roc_auc_mean == pytest.approx(r.cv_roc_auc_mean, abs=2e-3) and n.cv_f1_mean == r.cv_f1_mean


def test_vote_is_computed_once_and_releases_its_table(spark):
    spark.catalog.clearCache()
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                 (F.col("id") % 17 / 17.0).alias("score"))
    v = MD.soft_vote({"a": df, "b": df.withColumn("score", 1 - F.col("score"))}, "id", (1, 2))
    assert "Join" not in v._jdf.queryExecution().executedPlan().toString() and v.count() == 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@pytest.mark.parametrize("rows", [1 << 20, 50])
def test_auc_moves_rows_once_and_takes_any_score(spark, rows):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001 / 3001.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plan = MT.roc_auc(df, "s", "y", ["g"], rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # rows to their buckets, buckets to their groups
    odd = df.withColumn("s", F.when(F.col("s") > 0.9, float("inf")).when(F.col("s") < 0.2, float("-inf")).otherwise(F.col("s")))
    flat = df.withColumn("s", F.when(F.col("s") > 0.9, 2.0).when(F.col("s") < 0.2, -2.0).otherwise(F.col("s")))
    a, b = ({r.g: r.roc_auc for r in MT.roc_auc(d, "s", "y", ["g"], rows).collect()} for d in (odd, flat))
    assert a == pytest.approx(b)
    like = MT.roc_auc(df, "s", "y", ["g"], rows, like=flat, copies=2)
    assert {r.g: r.roc_auc for r in like.collect()} == {r.g: r.roc_auc for r in MT.roc_auc(df, "s", "y", ["g"]).collect()}
