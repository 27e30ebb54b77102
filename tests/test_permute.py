"""Keyed bijections of row positions and the importances they give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import model as MD
from tessera.operators import permute as PM


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 997, 4099, 10007])
def test_every_slot_is_a_bijection(spark, n):
    g = PM.grid(n)
    assert g.a * g.b >= n and 0 <= g.spare < g.a
    keys = [PM.round_keys(s, 5) for s in range(3)]
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), *[F.lit(k).cast("long").alias(f"k{r}") for r, k in enumerate(ks)])
                                for s, ks in enumerate(keys)])).alias("x")
    d = spark.range(n).withColumnRenamed("id", "_pos").select("_pos", slots) \
        .select("_pos", "x.s", *[F.col(f"x.k{r}").alias(f"_k{r}") for r in range(PM.ROUNDS)])
    got = PM.permuted_position(d, g, "_pos", "to").select("s", "_pos", "to").toPandas()
    images = []
    for _, one in got.groupby("s"):
        assert sorted(one["to"]) == list(range(n))
        images.append(one.sort_values("_pos")["to"].to_numpy())
    if n >= 900:  # neither order kept nor slots alike
        assert all(abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.12 for x in images)
        assert all((x == np.arange(n)).sum() < 12 for x in images)
        assert (images[0] == images[1]).sum() < 12 and (images[1] == images[2]).sum() < 12


def test_grids_of_large_tables_have_few_spare_cells():
    for n in (10 ** 9 + 7, 10 ** 12 + 39, 999_999_999_989, 2 ** 40 + 1):
        g = PM.grid(n)
        assert g.a * g.b >= n and g.spare <= 8


def _rows(spark, n=3000, parts=5):
    r = np.random.default_rng(1)
    a, b = r.normal(size=n), r.normal(size=n)
    rows = [(int(k) * 3, float(x), None if i % 10 == 0 else float(y), f"s{i % 4}", int(x + r.normal() > 0), int(i % 7))
            for i, (k, x, y) in enumerate(zip(r.permutation(n), a, b, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, label int, e int").repartition(parts)


def test_a_copy_changes_one_feature_and_keeps_its_values(spark):
    df = _rows(spark)
    want = df.toPandas().sort_values("id").reset_index(drop=True)
    got = PM.shuffled_copies(df, ["a", "b", "c", "e"], "id", 2).toPandas()
    assert sorted(got["_slot"].unique()) == [PM.AS_IS, *range(8)]
    for slot, one in got.groupby("_slot"):
        one = one.sort_values("id").reset_index(drop=True).drop(columns="_slot")
        moved = None if slot == PM.AS_IS else ["a", "b", "c", "e"][slot // 2]
        for c in want.columns:
            same = (one[c] == want[c]) | (one[c].isna() & want[c].isna())
            if c != moved:
                assert same.all()
            else:
                assert not same.all() and sorted(one[c].astype(str)) == sorted(want[c].astype(str))


def test_importance_of_a_scorer(spark):
    df = _rows(spark)
    score = lambda d: d.withColumn("score", F.col("a"))
    got = {r["feature"]: r for r in MD.permutation_importance(score, df, ["a", "e"], "id", repeats=3, rows_per_bucket=500).collect()}
    assert got["a"]["importance_mean"] > 0.2 and 0 < got["a"]["importance_std"] < 0.05
    assert got["e"]["importance_mean"] == 0 == got["e"]["importance_std"]
    one = MD.permutation_importance(score, df.limit(0), ["a"], "id", repeats=2).first()
    assert (one["importance_mean"], one["importance_std"]) == (0.0, 0.0)


def test_partitioning_does_not_matter(spark):
    score = lambda d: d.withColumn("score", F.col("a") + F.col("e"))
    one, two = (MD.permutation_importance(score, _rows(spark, parts=p), ["a", "e"], "id", repeats=2, rows_per_bucket=b).collect()
                for p, b in ((3, 200), (7, 1 << 20)))
    assert one == two
