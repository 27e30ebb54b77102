"""Block-wise pairwise moments against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import gram as GR
from tessera.operators import model as MD
from tessera.operators import profile as PR
from pyspark.sql import functions as F


def _table(n=600, d=60, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) @ r.normal(size=(d, d)) + 1e6 * r.normal(size=d)
    x[:, 5] = 7.25
    p = pd.DataFrame(x, columns=[f"x{i}" for i in range(d)])
    p["y"] = r.integers(0, 4, n)
    return p


def test_wide_correlations_are_pairwise_complete(spark):
    p = _table()
    hole = np.random.default_rng(4).random(p.shape) < 0.1
    hole[:, -1] = False
    p = p.mask(hole)
    cols = [c for c in p.columns if c != "y"]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in p[cols].itertuples(index=False)],
                               ", ".join(f"{c} double" for c in cols)).repartition(5)
    want = p[cols].corr()
    got = PR.correlation_matrix(df, cols).collect()
    assert len(got) == len(cols) ** 2 > PR.WIDE
    for r in got:
        w = want.loc[r.col_a, r.col_b]
        assert r.corr is None if "x5" in (r.col_a, r.col_b) else r.corr == pytest.approx(w, abs=1e-8)


@pytest.mark.parametrize("block", [16, 128])
def test_class_scatter_for_any_block_size(spark, block):
    p = _table(d=40)
    cols = [c for c in p.columns if c != "y"]
    df = spark.createDataFrame(p).repartition(7)
    within, means = GR.class_scatter(df, GR.vector_of(df, cols), F.col("y"), block)
    sw = np.zeros((40, 40))
    for r in within.collect():
        sw[r.i, r.j] = sw[r.j, r.i] = r.within
    want = sum((g[cols] - g[cols].mean()).T.values @ (g[cols] - g[cols].mean()).values for _, g in p.groupby("y"))
    assert np.allclose(sw, want, rtol=1e-7, atol=1e-4)
    for r in means.collect():
        g = p[p.y == r.label]
        assert r.n == len(g) and r["mean"] == pytest.approx(g[f"x{r.i}"].mean(), rel=1e-12)
    GR.release(means)


def test_arrays_of_other_length_are_refused_and_null_arrays_left_out(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), (None,), ([3.0, 5.0],)], "v array<double>")
    cells = {(r.i, r.j): r["corr"] for r in GR.correlation_cells(df, "v").collect()}
    assert cells[0, 1] == cells[1, 0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])
    with pytest.raises(Exception, match="elements"):
        GR.correlation_cells(df.unionAll(spark.createDataFrame([([1.0],)], "v array<double>")), "v").collect()
    assert GR.correlation_cells(df.where("false"), "v").count() == 0


def test_fisher_jobs_do_not_grow_with_classes(spark):
    p = _table(d=6)
    p["z"] = p.y * 5 + np.arange(len(p)) % 5
    counts = []
    for label in ("y", "z"):
        d = MD.to_vector(spark.createDataFrame(p).select(*[f"x{i}" for i in range(5)], label), [f"x{i}" for i in range(5)])
        spark.sparkContext.setJobGroup(f"fisher-{label}", "")
        MD.FisherDirection(inputCol="_v", outputCol="_l", labelCol=label).fit(d)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fisher-{label}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(counts[0] - counts[1]) <= 1
