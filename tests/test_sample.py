"""Ordering / sampling invariants: exact ranks without a single-task window,
folds partition the rows, stratification, determinism across partitionings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import sample as SA


def _keys(spark, n=5000, parts=7):
    return spark.range(0, n, 1, parts).withColumn("label", (F.col("id") % 5 == 0).cast("int"))


def test_ordered_index_bucketed_equals_row_number(spark):
    df = _keys(spark).withColumn("h", SA.mix64("id"))
    got = SA.ordered_index(df, ["h", "id"], rows_per_bucket=300).select("id", "_idx")
    exp = df.withColumn("_idx", F.row_number().over(Window.orderBy("h", "id")) - 1).select("id", "_idx")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_prefix_sums_partitioned(spark):
    df = _keys(spark).withColumn("v", F.col("id") % 7)
    got = SA.prefix_sums(df, ["id"], {"c": F.col("v")}, ["label"], rows_per_bucket=250)
    w = Window.partitionBy("label").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.withColumn("c", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.select("id", "c").exceptAll(exp.select("id", "c")).count() == 0


def test_folds_partition_and_stratify(spark):
    df = _keys(spark)
    f = SA.stratified_folds(df, "label", "id", 5)
    assert f.count() == df.count() and f.select("id").distinct().count() == df.count()
    counts = f.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in counts:
        by_label.setdefault(r.label, []).append(r["count"])
    for v in by_label.values():
        assert len(v) == 5 and max(v) - min(v) <= 1


def test_same_seed_same_folds_any_partitioning(spark):
    a = SA.stratified_folds(_keys(spark, parts=3), "label", "id", 5)
    b = SA.stratified_folds(_keys(spark, parts=11), "label", "id", 5)
    assert a.select("id", "fold").exceptAll(b.select("id", "fold")).count() == 0


def test_stratified_split_exact_share(spark):
    s = SA.stratified_split(_keys(spark), "label", "id", 0.2)
    shares = {r.label: r.t for r in s.groupBy("label").agg(F.avg(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(abs(v - 0.2) < 0.001 for v in shares.values())


def test_assign_batches_drops_remainder(spark):
    b = SA.assign_batches(spark.range(0, 1003, 1, 4), 10, "id", remainder="drop")
    assert b.count() == 1000
    sizes = {r.batch: r["count"] for r in b.groupBy("batch").count().collect()}
    assert sizes == {i: 100 for i in range(1, 11)}
    assert b.where("batch = 1").agg(F.max("id")).first()[0] == 99


def test_sample_n_deterministic(spark):
    a = SA.sample_n(_keys(spark, parts=2), 100, "id").select("id")
    b = SA.sample_n(_keys(spark, parts=9), 100, "id").select("id")
    assert a.count() == 100 and a.exceptAll(b).count() == 0


def test_mix64_no_overflow_large_keys(spark):
    df = spark.createDataFrame([(2 ** 62,), (12345678901234,)], "k long")
    vals = [r[0] for r in df.select(SA.mix64("k")).collect()]
    assert all(0 <= v < 2 ** 32 for v in vals)


def test_top_k_ties_by_key_nulls_never(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0)], "k int, v double")
    assert [r.k for r in SA.top_k(df, 3, "v", "k").collect()] == [1, 2, 4]


def test_rolling_mean_min_periods(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0), (4, 7.0)], "b int, m double")
    out = [r.m_ma for r in SA.rolling_mean(df, ["m"], "b", 3).orderBy("b").collect()]
    assert out == [1.0, 2.0, 3.0, 5.0]


def test_option_paths(spark):
    from tessera.operators import profile as PR
    df = _keys(spark)
    x = SA.sample_n(df, 50, "id", hash="xxhash")
    assert x.count() == 50 and x.select("id").distinct().count() == 50
    s = SA.stratified_split(df, "label", "id", 0.2, exact=False)
    share = s.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.03
    d = PR.describe(df.withColumn("v", F.col("id") * 1.0), ["v"], approx=True).first()
    assert abs(d.p50 - 2500) < 60 and d["count"] == 5000


def test_string_rank_bucketed(spark):
    df = spark.range(0, 3000, 1, 5).select(F.format_string("k%05d", (F.col("id") * 7919) % 3000).alias("s"))
    got = SA.string_rank(df, "s", rows_per_bucket=200).select("s", "_rank")
    exp = df.withColumn("_rank", F.row_number().over(Window.orderBy("s")) - 1)
    assert got.exceptAll(exp).count() == 0 and got.count() == 3000


def test_factorize_alpha(spark):
    from tessera.functions import columns as C
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "k int, c string")
    out = {r.k: r.c_encoded for r in C.factorize(df, "c", key="k", order="alpha").collect()}
    assert out == {1: 1, 2: 0, 3: 2, 4: -1}


def _mixed(n, seed=42):
    def h(k):
        x = (k % SA.MOD32) ^ (k >> 32) ^ SA.mixed_seed(seed)
        for _ in range(2):
            x = ((x ^ (x >> 16)) * SA.HASH_MULT) % SA.MOD32
        return x ^ (x >> 16)
    return [h(k) for k in range(n)]


def test_mix64_matches_plain_arithmetic(spark):
    got = [r[0] for r in spark.range(0, 500, 1, 1).select(SA.mix64("id", 7)).collect()]
    assert got == _mixed(500, 7)


def test_holdout_is_not_made_of_key_blocks():
    """Runs of neighbouring keys in a 20 % hash holdout are as short as chance
    makes them, seeds give unrelated orders, and the hash does not follow the key."""
    import numpy as np
    n = 20_000
    a, b = np.array(_mixed(n, 42)), np.array(_mixed(n, 43))
    inside = a % 10_000 < 2000
    edges = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1], True])
    runs = np.diff(edges)[inside[edges[:-1]]]
    assert abs(runs.mean() - 1.25) < 0.05 and runs.max() < 12
    rank = lambda x: np.argsort(np.argsort(x))
    assert abs(np.corrcoef(rank(a), rank(b))[0, 1]) < 0.03
    assert abs(np.corrcoef(rank(a), np.arange(n))[0, 1]) < 0.03
    assert abs(np.arange(n)[inside].mean() - np.arange(n).mean()) < 4 * n / (12 * inside.sum()) ** 0.5


def test_holdout_covers_the_time_range(spark):
    from conftest import SF001
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", F.unix_timestamp("ts").alias("t"), "event_type")
    s = SA.stratified_split(ev, "event_type", "event_id", 0.2)
    r = s.groupBy("is_test").agg(F.avg("t").alias("m"), F.stddev("t").alias("sd"), F.count("t").alias("n")).collect()
    t, h = sorted(r, key=lambda x: x.is_test)
    assert abs(t.m - h.m) < 4 * t.sd * (1 / t.n + 1 / h.n) ** 0.5


def test_boundaries_match_a_sort(spark):
    import random

    from tessera.operators import boundaries as BO
    rng = random.Random(3)
    rows = [("ab"[rng.random() < 0.3], rng.choice([rng.randint(-2 ** 63, 2 ** 63 - 1), rng.randint(-5, 5)]), i)
            for i in range(700)] + [(None, 4, 9001), (None, 4, 9000), ("a", None, 9002)]
    df = spark.createDataFrame(rows, "c string, v long, k long").repartition(3)
    found = BO.find(df, F.col("v"), lambda n: [0, 1, n // 3, n - 1, n], "c", F.col("k"))
    for c in ("a", "b", None):
        own = sorted((BO.LOWEST if v is None else v, k) for x, v, k in rows if x == c)
        n, got = found[c]
        assert n == len(own) and got[-1] is None
        for r, g in zip([0, 1, n // 3, n - 1], got, strict=False):
            first = own.index(next(o for o in own if o[0] == g[0]))
            assert g[0] == own[r][0] and g[1] in ((own[r][1],) if r > first else (None, own[r][1])) and not g[2]
    seg = BO.segment(df, F.col("v"), found, "c", F.col("k"))
    counts = {(r.c, r._segment): r["count"] for r in seg.groupBy("c", "_segment").count().collect()}
    n = found["a"][0]
    assert counts[("a", 1)] == 1 and counts[("a", 4)] == 1 and sum(v for (c, _), v in counts.items() if c == "a") == n


def test_splits_move_no_row(spark):
    plan = SA.stratified_folds(_keys(spark), "label", "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan


def test_assign_batches_keeps_the_remainder(spark):
    sizes = {r.batch: r["count"] for r in SA.assign_batches(spark.range(0, 1003, 1, 4), 10, "id").groupBy("batch").count().collect()}
    assert sizes == {**{i: 100 for i in range(1, 10)}, 10: 103}
    few = SA.assign_batches(spark.range(3), 5, "id").orderBy("id").collect()
    assert [r.batch for r in few] == [1, 2, 3]
    assert SA.assign_batches(spark.range(3), 5, "id", remainder="drop").count() == 0


def test_prefix_sums_rank_nulls_first_at_every_size(spark):
    df = spark.range(0, 300, 1, 3).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("x"))
    a = SA.ordered_index(df, ["x", "id"], rows_per_bucket=20)
    b = SA.ordered_index(df, ["x", "id"], rows_per_bucket=10_000)
    assert a.select("id", "_idx").exceptAll(b.select("id", "_idx")).count() == 0
    assert a.where("x IS NULL").agg(F.max("_idx")).first()[0] == 5


def test_repeated_keys_raise_or_stay_together(spark):
    """No silent empty test set: a key that repeats is refused, a group is kept whole."""
    import pytest

    from tessera.operators.boundaries import RepeatedKey
    one = spark.createDataFrame([(7, i % 2, i) for i in range(1000)], "g long, label int, id long").repartition(4)
    none = one.withColumn("g", F.lit(None).cast("long"))
    for d in (one, none):
        with pytest.raises(RepeatedKey):
            SA.stratified_split(d, "label", "g", 0.2)
        with pytest.raises(RepeatedKey):
            SA.stratified_folds(d, "label", "g", 5)
    many = spark.createDataFrame([(i * i % 97 if i % 50 else None, i % 2, i) for i in range(3000)], "g long, label int, id long").repartition(5)
    split = SA.stratified_split(many, "label", "id", 0.2, group="g")
    assert split.count() == 3000 and split.groupBy("g").agg(F.countDistinct("is_test").alias("k")).where("k > 1").count() == 0
    largest = many.groupBy("g").count().agg(F.max("count")).first()[0]
    assert abs(split.where("is_test").count() - 600) <= largest / 2
    folds = SA.stratified_folds(many, "label", "id", 5, group="g")
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and all(abs(n - 600) <= largest for n in sizes)


def test_range_rank_without_a_bucket_for_ties(spark):
    """All first columns equal: the rows still spread over the partitions."""
    d = spark.range(20_000).select(F.lit(-1).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(4)
    out = SA.range_rank(d, ["n", "v"], "r", rows_per_bucket=2_000)
    rows = [(r.v, r.r) for r in out.collect()]
    assert [v for v, _ in sorted(rows, key=lambda x: x[1])] == sorted(v for v, _ in rows)
    assert sorted(r for _, r in rows) == list(range(20_000))
    assert SA.range_rank(d, ["n", "v"], "r").where("r < 0").count() == 0  # one bounded window
