"""Runs of K-Means that go on together, against Spark's own fits."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import lloyd as LL


def test_runs_together_give_what_single_fits_give(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=2) + 6 * (i % 3)]) for i in range(300)]
    z = spark.createDataFrame(rows, "id long, a array<double>").repartition(3, "id").select("id", array_to_vector("a").alias("z")).persist()
    z.count()
    runs = [(k, s) for k in (2, 3) for s in (1, 2, 3)]
    sc = spark.sparkContext
    sc.setJobGroup("together", "")
    fits = LL.fit_all(z, "z", runs, 50)
    sc.setJobGroup("others", "")
    for k, seed in runs:
        m = KMeans(k=k, seed=seed, featuresCol="z", maxIter=50).fit(z)
        cost, centres = fits[k, seed]
        assert cost == pytest.approx(m.summary.trainingCost)
        assert np.allclose(centres, np.array(m.clusterCenters()))
    best = LL.best_of(fits, 3)
    assert best[0] == min(fits[3, s][0] for s in (1, 2, 3))
    got = LL.assigned(z, "z", best[1], "c")
    assert got.count() == 300 and got.groupBy("c").count().count() == 3
    assert got.groupBy(F.col("id") % 3).agg(F.countDistinct("c").alias("n")).where("n > 1").count() == 0
    z.unpersist()
