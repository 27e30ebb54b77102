"""Model operators: invariants (AUC range, fold coverage, determinism)."""

from pyspark.sql import functions as F

from tessera.operators import experiment as EX
from tessera.operators import model as MD

from conftest import SF001


def _table(spark):
    from tessera.plans.modeling import ml_table
    return ml_table(spark, SF001)


def test_translate_params():
    p = MD.translate_params("random_forest", {"n_estimators": 50, "min_samples_split": 5, "ccp_alpha": 0.1})
    assert p == {"numTrees": 50, "minInstancesPerNode": 3}
    assert MD.translate_params("logistic", {"C": 2.0}, 100)["regParam"] == 1 / 200
    assert MD.translate_params("gbt", {"num_leaves": 31})["maxDepth"] == 5


def test_cross_validate_invariants(spark):
    from tessera.plans.modeling import FEATURES
    train, test = EX.prepare(_table(spark), "label", "event_id", 0.2, 3, 42)
    n_all = _table(spark).count()
    assert train.count() + test.count() == n_all
    pipe = MD.build_pipeline("decision_tree", FEATURES, {"max_depth": 3}, "label", "weight")
    m, oof = MD.cross_validate(pipe, train.persist(), "event_id", "label", "fold", "tree")
    assert oof.count() == train.count()  # every training row predicted exactly once
    assert m.where("roc_auc < 0 OR roc_auc > 1").count() == 0 and m.count() == 3


def test_soft_vote_weights_grid(spark):
    from tessera.plans.modeling import FEATURES
    train, _ = EX.prepare(_table(spark), "label", "event_id", 0.2, 3, 42)
    train = train.persist()
    oofs = {}
    for name in ("logistic", "decision_tree"):
        _, oofs[name] = MD.cross_validate(MD.build_pipeline(name, FEATURES, {}, "label", "weight"), train,
                                          "event_id", "label", "fold", name)
    v = MD.soft_vote(oofs, "event_id", (1, 2))
    assert v.count() == 4


def test_fisher_direction_separates(spark):
    rows = [(i, float(i % 2) * 3.0 + (i % 7) * 0.1, (i % 5) * 0.2, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    out = MD.fisher_projection(df, ["a", "b"], "y", "id")
    means = {r.y: r.m for r in out.groupBy("y").agg(F.avg("lda_0").alias("m")).collect()}
    assert abs(means[1] - means[0]) > 1.0


def test_kmeans_scan_and_pca(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    k = MD.kmeans_scan(emb, "embedding", (2, 3), n_init=2)
    assert k.count() == 2 and k.where("inertia <= 0").count() == 0
    pcs = MD.pca_scores(emb, "embedding", "vec_id", 2)
    assert pcs.count() == emb.count() and set(pcs.columns) == {"vec_id", "pc_0", "pc_1"}


def test_categorical_branch_unknown_is_zeros_null_is_mode(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    train = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "c string")
    stages, out = MD.categorical_stages(["c"], drop_first=True)
    m = Pipeline(stages=stages).fit(train)
    test = spark.createDataFrame([(1, "a"), (2, "c"), (3, "z"), (4, None)], "k int, c string")
    rows = {r.k: r.v for r in m.transform(test).select("k", vector_to_array(out[0]).alias("v")).collect()}
    assert rows[1] == [0.0, 0.0]            # first category dropped
    assert rows[2] == [0.0, 1.0]
    assert rows[3] == [0.0, 0.0]            # unknown -> zeros
    assert rows[4] == [1.0, 0.0]            # null -> mode ("b")


def test_custom_stages_persist(spark, tmp_path):
    from pyspark.ml import PipelineModel
    rows = [(i, float(i % 7), float((i * 3) % 11), ["x", "y", None][i % 3], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, label int")
    pipe = MD.build_pipeline("logistic", ["a", "b"], {"C": 1.0}, "label", None,
                             reducer={"method": "lda"}, categorical=["c"])
    model = pipe.fit(df)
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    p1 = [r.probability[1] for r in model.transform(df).orderBy("id").select("probability").collect()]
    p2 = [r.probability[1] for r in back.transform(df).orderBy("id").select("probability").collect()]
    assert p1 == p2


def test_the_vote_can_win_and_is_logged_registered_and_scored(spark, tmp_path):
    """Two models that each see a part of the signal: their vote beats both, is
    refitted, scores the holdout, is registered, loaded back and scores the same."""
    import random

    from tessera.sources import tracking as TR
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, x, z, int(rng.random() < 1 / (1 + 2.718 ** -(1.2 * x + 2.2 * abs(z) - 1.8)))))
    df = spark.createDataFrame(rows, "id long, x double, z double, y int").repartition(2)
    base = str(tmp_path / "registry")
    cfg = {"models": {"logistic": {"C": 1.0}, "decision_tree": {"max_depth": 3}}, "folds": 3, "parallelism": 2,
           "search": {"logistic": ({"C": ("log", 0.01, 10.0)}, 2)}, "registry": base, "name": "risk", "scale_columns": ["x"]}
    out = EX.run_experiment(df, ["x", "z"], "y", "id", cfg)
    assert out["best"] == "soft_vote" and out["ranking"].where("rank = 1").first()["model"] == "soft_vote"
    s = out["summary"].first()
    assert s.best_model == "soft_vote" and s.holdout_roc_auc > 0.6
    p = out["model"].transform(df).select("probability", "prediction")
    assert p.count() == 3000 and p.where("prediction NOT IN (0, 1)").count() == 0
    runs = TR.read_runs(spark, base)
    stages = {r.stage: r["count"] for r in runs.groupBy("stage").count().collect()}
    assert stages == {"baseline": 2, "trial": 2, "vote": 1, "champion": 1}
    champion = runs.where("stage = 'champion'").first()
    assert abs(champion.metrics["roc_auc"] - s.holdout_roc_auc) < 1e-9
    assert [(r.name, r.version) for r in TR.read_versions(spark, base).collect()] == [("risk", out["version"])]
    back = TR.load_model(spark, base, "risk")
    assert type(back) is MD.VoteModel and [w for w, _ in back.members] == [w for w, _ in out["model"].members]

    def scores(m):
        return [(r.id, r.probability, r.decision) for r in MD.score(m, df, 0.3, keep=["id"]).orderBy("id").collect()]
    assert scores(back) == scores(out["model"])
    names = MD.assembler_names(out["model"].members[0][1])
    assert sorted(names) == ["x", "z"]


def test_one_penalty_for_folds_and_refit(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 2, i % 3) for i in range(60)], "id long, x double, label int, fold int")
    pipe = MD.build_pipeline("logistic", ["x"], {"C": 2.0}, "label")
    assert MD.fit_pipeline(pipe, df).stages[-1].getRegParam() == 1 / 120
    assert MD.fit_pipeline(pipe, df.where("fold <> 0")).stages[-1].getRegParam() == 1 / 80


def test_two_writers_never_share_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tessera.sources import tracking as TR
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, label int")
    model = MD.build_pipeline("decision_tree", ["x"], {"max_depth": 2}, "label").fit(df)
    with ThreadPoolExecutor(3) as ex:
        got = list(ex.map(lambda _: TR.save_model(spark, str(tmp_path), "m", model), range(3)))
    assert sorted(got) == [1, 2, 3]


def test_model_queries_leave_no_cache(spark):
    from conftest import SF001
    from tessera.plans import QUERIES
    spark.catalog.clearCache()
    for name in ("cv01_cross_validate", "ag03_value_counts"):
        QUERIES[name](spark, SF001).collect()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0, name
