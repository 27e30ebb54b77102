"""Null rules N1-N12 and the feature expressions on hand-made frames."""

import math

from pyspark.sql import functions as F

from tessera.functions import columns as C


def test_flag_null_is_zero(spark):  # N3
    df = spark.createDataFrame([(1.0,), (None,), (-2.0,), (4.0,)], "x double")
    out = [r[0] for r in df.select(C.flag_expr("x", 0)).collect()]
    assert out == [1, 0, 0, 1]


def test_log1p_clip_keeps_null(spark):  # N4
    df = spark.createDataFrame([(1.0,), (None,), (-2.0,), (4.0,)], "x double")
    out = [r[0] for r in df.select(C.log1p_clip_expr("x")).collect()]
    assert out[1] is None and out[2] == 0.0
    assert abs(out[0] - math.log(2)) < 1e-12 and abs(out[3] - math.log(5)) < 1e-12


def test_ratio_zero_policies(spark):  # N5
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "a double, b double")
    eps = [r[0] for r in df.select(C.ratio_expr("a", "b", "epsilon")).collect()]
    nul = [r[0] for r in df.select(C.ratio_expr("a", "b", "null")).collect()]
    assert eps[0] == 0.5 and abs(eps[1] - 1000.0) < 1e-9 and eps[2] is None and eps[3] is None
    assert nul == [0.5, None, None, None]


def test_ordinal_unmapped_and_null(spark):  # N6
    df = spark.createDataFrame([("a",), ("",), ("None",), (None,)], "c string")
    out = [r[0] for r in df.select(C.ordinal_expr("c", {"a": 0, "None": 5})).collect()]
    assert out == [0, -1, 5, -1]


def test_one_hot_blank_is_value_null_all_zero(spark):  # N7
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "None"), (4, None)], "k int, c string")
    out = C.one_hot(df, "c").orderBy("k").collect()
    assert sorted(c for c in out[0].asDict() if c.startswith("cat_")) == ["cat_c_", "cat_c_None", "cat_c_a"]
    assert (out[3]["cat_c_"], out[3]["cat_c_None"], out[3]["cat_c_a"]) == (0, 0, 0)
    assert out[1]["cat_c_"] == 1
    dropped = C.one_hot(df, "c", drop_first=True)
    assert "cat_c_" not in dropped.columns


def test_label_from_map(spark):  # N12
    df = spark.createDataFrame([("Yes",), ("No",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(C.label_from_map("t", {"Yes": 1, "No": 0})).collect()]
    assert out == [1, 0, None, None]


def test_cut_right_closed_lowest_included(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (30.1,), (120.0,), (121.0,), (None,)], "x double")
    out = [r[0] for r in df.select(C.cut_expr("x", [0, 30, 120])).collect()]
    assert out == [0, 0, 1, 1, None, None]
    labels = [r[0] for r in df.select(C.cut_label_expr("x", [0, 30, 120], ["lo", "hi"])).collect()]
    assert labels == ["lo", "lo", "hi", "hi", None, None]


def test_qcut_duplicate_edges_merged(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]], "x double")
    edges = C.quantile_edges(df, ["x"], 4)["x"]
    assert edges == sorted(set(edges)) and edges[0] == 1.0 and edges[-1] == 5.0
    out = C.qcut(df, ["x"], 4).select("x_bin").collect()
    assert all(r[0] is not None for r in out)


def test_factorize_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None), (5, "c")], "k int, c string")
    out = {r["k"]: r["c_encoded"] for r in C.factorize(df, "c", key="k").collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: -1, 5: 2}


def test_conform_fills_absent_columns_only(spark):  # PF-5
    df = spark.createDataFrame([(1, None)], "a int, b double")
    r = C.conform(df, ["b", "a", "z"]).first()
    assert r["b"] is None and r["a"] == 1 and r["z"] == 0


def test_decide_and_risk_factors(spark):  # PF-10, PF-11
    df = spark.createDataFrame([(0.3, 26.0), (0.29, 20.0), (None, None)], "p double, bmi double")
    out = df.select(C.decide("p", 0.30).alias("d"), C.decide("p", 0.30, strict=True).alias("s"),
                    F.array_join(C.risk_factors([("BMI>25", F.col("bmi") > 25)], "none"), "|").alias("f")).collect()
    assert [(r.d, r.s, r.f) for r in out] == [(1, 0, "BMI>25"), (0, 0, "none"), (0, 0, "none")]


def test_round_half_even(spark):  # PF-12
    df = spark.createDataFrame([(0.125,), (0.135,)], "x double")
    assert [r[0] for r in df.select(C.round_half_even("x", 2)).collect()] == [0.12, 0.14]


def test_median_fill_of_integer_column_is_double(spark):
    from tessera.operators import impute as IM
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    out = [r[0] for r in IM.impute_median(df, ["x"]).collect()]
    assert out[-1] == 2.5 and dict(IM.impute_median(df, ["x"]).dtypes)["x"] == "double"
