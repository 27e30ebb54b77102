"""Statistical conventions and the FIXTURES section 5 frames."""

import math

from pyspark.sql import functions as F

from tessera.functions.distributions import chi2_sf, f_sf
from tessera.operators import metrics as MT
from tessera.operators import pivot as PV
from tessera.operators import profile as PR
from tessera.operators import stats as ST


def test_describe_conventions(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-2.0,), (4.0,)], "x double")
    r = PR.describe(df, ["x"]).first()
    assert r["count"] == 3
    assert abs(r["std"] - 3.0) < 1e-12  # sample std of 1, -2, 4
    assert r["p50"] == 1.0 and r["p25"] == -0.5 and r["p75"] == 2.5  # linear interpolation
    # bias-corrected G1 skewness (pandas skew)
    xs = [1.0, -2.0, 4.0]
    n, m = 3, sum(xs) / 3
    m2 = sum((x - m) ** 2 for x in xs) / n
    m3 = sum((x - m) ** 3 for x in xs) / n
    g1 = m3 / m2 ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    assert abs(r["skewness"] - g1) < 1e-12


def test_chi2_yates_and_plain(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 4 + [("b", "y")] * 9
    df = spark.createDataFrame(rows, "a string, b string")
    plain = ST.chi2_stat(df, [("a", "b")], yates=False).first()
    assert abs(plain["chi2"] - 3.58974) < 1e-5 and plain["dof"] == 1
    corr = ST.chi2_independence(df, [("a", "b")], yates=True).first()
    # Yates: (|ad-bc| - N/2)^2 N / (r1 r2 c1 c2)
    N = 28
    exp = (abs(10 * 9 - 5 * 4) - N / 2) ** 2 * N / (15 * 13 * 14 * 14)
    assert abs(corr["chi2"] - exp) < 1e-9
    assert abs(corr["p_value"] - chi2_sf(exp, 1)) < 1e-12


def test_chi2_unobserved_cell(spark):
    rows = [("a", "x")] * 3 + [("b", "y")] * 2 + [("c", "x")] * 4 + [("c", "y")] * 1
    df = spark.createDataFrame(rows, "a string, b string")
    r = ST.chi2_stat(df, [("a", "b")], yates=False).first()
    # full 3x2 grid by hand (the (a,y) and (b,x) cells are zero)
    obs = {("a", "x"): 3, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 2, ("c", "x"): 4, ("c", "y"): 1}
    N = 10
    rs = {"a": 3, "b": 2, "c": 5}
    cs = {"x": 7, "y": 3}
    exp = sum((o - rs[a] * cs[b] / N) ** 2 / (rs[a] * cs[b] / N) for (a, b), o in obs.items())
    assert abs(r["chi2"] - exp) < 1e-9 and r["dof"] == 2


def test_anova_matches_closed_form(spark):
    rows = [("g1", v) for v in (1.0, 2.0, 3.0)] + [("g2", v) for v in (2.0, 4.0, 6.0, None)]
    df = spark.createDataFrame(rows, "g string, x double")
    r = ST.anova_oneway(df, ["x"], "g").first()
    # between: means 2 and 4, grand 3; SSB = 3*1 + 3*1 = 6; SSW = 2 + 8 = 10
    assert abs(r["f_stat"] - (6 / 1) / (10 / 4)) < 1e-12
    assert abs(r["p_value"] - f_sf(2.4, 1, 4)) < 1e-12


def test_f_sf_known_values():
    # F(1, 10) = t(10)^2: the two-sided 5 % point of t(10) is 2.228138851986
    assert abs(f_sf(2.228138851986 ** 2, 1, 10) - 0.05) < 1e-9
    # F(1, d2) -> chi2(1) for large d2
    assert abs(f_sf(3.841458820694124, 1, 1e9) - 0.05) < 1e-6


def test_chi2_sf_known_values():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9


def test_auc_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int")
    assert MT.roc_auc(df, "p", "y").first()["roc_auc"] == 0.875
    # bucketed path gives the same result
    assert MT.roc_auc(df, "p", "y", rows_per_bucket=1).first()["roc_auc"] == 0.875


def test_auc_single_class_is_half(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "p double, y int")
    assert MT.roc_auc(df, "p", "y").first()["roc_auc"] == 0.5


def test_pivot_drops_null_keys_keeps_blank(spark):  # N8
    df = spark.createDataFrame([("", "a", 1.0), (None, "a", 5.0), ("m", None, 3.0), ("m", "a", 2.0)],
                               "i string, c string, v double")
    rows = {r["i"]: r["a"] for r in PV.pivot_mean(df, "i", "c", "v").collect()}
    assert rows == {"": 1.0, "m": 2.0}


def test_correlation_pairwise_complete(spark):  # N10
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    r = {(x.col_a, x.col_b): x.corr for x in PR.correlation_matrix(df, ["a", "b"]).collect()}
    assert abs(r[("a", "b")] - 1.0) < 1e-12 and abs(r[("b", "a")] - 1.0) < 1e-12


def test_jarque_bera_closed_form(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = ST.normality_test(df, ["x"]).first()
    n = len(xs)
    m = sum(xs) / n
    m2 = sum((x - m) ** 2 for x in xs) / n
    s = sum((x - m) ** 3 for x in xs) / n / m2 ** 1.5
    k = sum((x - m) ** 4 for x in xs) / n / m2 ** 2 - 3
    jb = n / 6 * (s * s + k * k / 4)
    assert abs(r["statistic"] - jb) < 1e-9 and abs(r["p_value"] - math.exp(-jb / 2)) < 1e-12


def test_value_counts_share(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    out = {r.value: (r["count"], r.share) for r in PR.value_counts(df, "c").collect()}
    assert out == {"a": (2, 2 / 3), "b": (1, 1 / 3)}
    out2 = {r.value: r.share for r in PR.value_counts(df, "c", dropna=False).collect()}
    assert out2[None] == 0.25


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    rows = {r.bin: r["count"] for r in PR.histogram(df, "x", 5).collect()}
    assert sum(rows.values()) == 11 and rows[4] == 3


def test_f_sf_reproduces_published_anova():
    # published reference ANOVA rows (feature, F, p) with dof (1, n - 2),
    # n = 10,000 rows minus the column's nulls (29 / 19 / 22)
    assert abs(f_sf(0.8528299853856534, 1, 9969) - 0.3557753304234788) < 1e-9
    assert abs(f_sf(1.9257785122451976, 1, 9979) - 0.16525202264503197) < 1e-9
    assert abs(f_sf(3.87120658223427, 1, 9976) - 0.049148857774150366) < 1e-9


def _lowess(x, y, frac, at):
    import numpy as np
    k = max(2, int(frac * len(x) + 1e-10))
    out = []
    for p in at:
        d = np.abs(x - p)
        h = np.sort(d)[k - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        b = ((w.sum() * (w * x * y).sum() - (w * x).sum() * (w * y).sum())
             / (w.sum() * (w * x * x).sum() - (w * x).sum() ** 2))
        out.append(((w * y).sum() - b * (w * x).sum()) / w.sum() + b * p)
    return np.array(out)


def test_smooth_grid_is_linear_and_exact_at_its_points(spark):
    """100,000 points; the fits at the ends of the cells are those of a plain LOWESS."""
    import numpy as np
    m = 100_000
    d = spark.range(m).select((F.col("id") * 0.001 + F.sin(F.col("id") * 1.7) * 0.0004).alias("x"),
                              (F.sin(F.col("id") * 0.0001) * 3 + F.pmod(F.col("id") * 7919, F.lit(100)) / 50).alias("y"))
    out = ST.smooth(d, "x", "y", frac=0.3, delta=0.05, rows_per_bucket=20_000).toPandas().sort_values("x")
    x, y, f = (out[c].to_numpy() for c in ("x", "y", "smooth"))
    assert len(x) == m
    cell = np.floor((x - x[0]) / ((x[-1] - x[0]) * 0.05))
    ends = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    assert np.allclose(f[ends], _lowess(x, y, 0.3, x[ends]), rtol=1e-6)
    points = np.unique(np.r_[ends, ends[1:] - 1, m - 1])  # the first and last point of every cell
    assert np.allclose(f, np.interp(x, x[points], f[points]), rtol=1e-9)
    robust = ST.smooth(d.withColumn("y", F.when(F.col("x") < 0.5, 1000.0).otherwise(F.col("y"))), "x", "y", frac=0.3, it=2, delta=0.05)
    assert abs(robust.where("x > 40 AND x < 41").agg(F.avg("smooth")).first()[0] - f[(x > 40) & (x < 41)].mean()) < 0.2
    assert ST.smooth(d.limit(0), "x", "y", delta=0.1).count() == 0


def test_chi_square_margins_of_a_hot_value_are_no_window(spark):
    d = spark.range(0, 20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("a"),
                                     (F.col("id") % 300).alias("b"))
    plan = ST.chi2_stat(d, [("a", "b")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
