"""Saved stages, the vote as a model, and joins without an exchange."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import impute as IM
from tessera.operators import lookup as LK
from tessera.operators import stages as SG
from tessera.operators.vote import LinearScorer, VoteModel, positive_score


def table(spark):
    return spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, float(i % 11) if i % 5 else None, i % 2) for i in range(200)],
                                 "id long, g string, x double, y int").repartition(3)


def test_one_saved_model_takes_raw_rows(spark, tmp_path):
    df = table(spark)
    config = {"binary_flags": [{"column": "x", "value": 5, "new_column": "big"}, {"column": "gone", "value": 1, "new_column": "flag"}],
              "categorical_encoding": {"columns": ["g"], "mappings": {"g": {"a": 0, "b": 1}}}, "features_to_keep": ["x", "big", "flag", "g_encoded", "cat_g_a", "cat_g_c"]}
    pipe = Pipeline(stages=[SG.GroupMedianImputer("g", "x"), SG.FeatureBuilder(config, carry=["id", "y"]), SG.Standardizer(["x"])])
    model = pipe.fit(df)
    model.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    # raw rows of another table: a new category, no label, a missing column
    raw = spark.createDataFrame([(1, "zzz", 3.0), (2, "a", None), (3, None, None)], "id long, g string, x double")
    a, b = ([tuple(r) for r in m.transform(raw.withColumn("y", F.lit(0))).orderBy("id").collect()] for m in (model, back))
    assert a == b
    assert back.transform(raw.withColumn("y", F.lit(0))).columns[:2] == ["id", "y"]
    rows = {r.id: r for r in back.transform(raw.withColumn("y", F.lit(0))).collect()}
    assert rows[1].g_encoded == -1 and rows[1].cat_g_a == 0 and rows[2].cat_g_a == 1 and rows[3].x is None
    median = IM.group_medians(df, "g", "x").where("_g = 'a'").first()["_gm"]
    filled = IM.impute_group_median(df, "g", "x")
    m, s = filled.agg(F.avg("x"), F.stddev_samp("x")).first()
    assert rows[2].x == pytest.approx((median - m) / (s + 1e-9))


def test_vote_is_saved_and_loaded_with_its_members(spark, tmp_path):
    df = table(spark).withColumn("probability", F.lit("old"))
    vote = VoteModel([(2, PipelineModel([LinearScorer(["x"], [0.3], -1.0)])), (1, PipelineModel([LinearScorer(["y"], [1.0])]))], 0.4)
    vote.write().save(str(tmp_path / "v"))
    back = VoteModel.load(str(tmp_path / "v"))
    assert back.uid == vote.uid and back.getOrDefault("threshold") == 0.4

    def out(m):
        p = m.transform(df)
        return {r.id: (r.s, r.prediction) for r in p.select("id", positive_score(p).alias("s"), "prediction").collect()}
    got = out(back)
    assert got == out(vote) and len(got) == 200
    from math import exp
    for r in table(spark).collect():
        if r.x is None:
            assert got[r.id][0] is None
        else:
            p = (2 / (1 + exp(1 - 0.3 * r.x)) + 1 / (1 + exp(-r.y))) / 3
            assert got[r.id][0] == pytest.approx(p) and got[r.id][1] == float(p >= 0.4)
    with pytest.raises(ValueError):
        VoteModel([(0, PipelineModel([]))])


def test_lookup_moves_no_row(spark):
    df = table(spark)
    right = df.where("id % 3 = 0").select("id", (F.col("id") * 2).alias("cluster"))
    left = LK.as_bucketed(df.select("id", "x"), "id", 4)
    out = LK.row_lookup(left, LK.as_bucketed(right, "id", 4), "id", 4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["id", "x", "cluster"]
    assert {(r.id, r.cluster) for r in out.collect()} == {(i, 2 * i) for i in range(0, 200, 3)}


def test_nearest_centre(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 2.0, 2.0), (4, None, 1.0)], "id long, a double, b double")
    got = {r.id: r.cluster for r in LK.nearest_centre(d, ["a", "b"], [(0, 0), (4, 4)]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: None}
