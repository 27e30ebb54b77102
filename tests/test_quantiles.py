"""Exact quantiles (histogram bisection and the grouped bucketed plan) equal
Spark's percentile, including a value holding a third of the rows."""

from pyspark.sql import functions as F

from tessera.operators import quantiles as QN


def _frame(spark):
    # 1/3 of the rows carry the same value (hot value), one all-null column
    return spark.range(0, 3000, 1, 6).select(
        F.col("id"), (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * 1.5).alias("x"),
        F.lit(None).cast("double").alias("e"))


def test_bisection_equals_percentile(spark):
    df = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    exp = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]
    for bins, limit in ((4, 10), (1024, 50_000), (2, 1)):   # several passes / one pass / deepest
        got = QN.exact_quantiles(df, ["x", "e"], probs, bins=bins, collect_limit=limit)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got["x"], exp)), (bins, limit)
        assert got["e"] == [None] * len(probs)


def test_grouped_quantiles(spark):
    df = _frame(spark)
    got = {r.g: r.value for r in QN.quantiles_frame(df, ["x"], [0.5], by=["g"], rows_per_bucket=50).collect()}
    exp = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in got)


def test_infinities_and_nan_do_not_depend_on_the_limit(spark):
    from tessera.operators.quantiles import exact_quantiles
    inf = float("inf")
    rows = [(float(i),) for i in range(100)] + [(inf,), (-inf,), (float("nan"),), (None,), (1e308,), (-1e308,)]
    df = spark.createDataFrame(rows, "x double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    a, b = exact_quantiles(df, ["x"], probs)["x"], exact_quantiles(df, ["x"], probs, bins=4, collect_limit=1)["x"]
    assert a == b and a[0] == -inf and a[-1] == inf and a[2] == 49.5


def test_box_stats_without_values(spark):
    from tessera.operators.profile import box_stats
    r = box_stats(spark.createDataFrame([(None,), (None,)], "x double"), "x").first()
    assert r.q1 is None and r.n_outliers == 0
