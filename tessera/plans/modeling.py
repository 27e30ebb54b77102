"""Model queries (ML-*, CV-*, SC-1, IO-10..12).  Their outputs are metric
tables of Spark ML fits, so they have no SQL twin (rows-only check); the
invariants are covered by tests (folds partition rows, AUC in [0, 1], same
seed -> same folds).

ML table: ``events`` (unique ``event_id``; label = purchase, ~20 % positive
like the reference's target) with per-user aggregates joined back.  Sizes
(trees, rounds, repeats, restarts, trials) are the library's defaults.  The
holdout is drawn before the user averages are computed, which see training
rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import experiment as EX
from tessera.operators import folds as FO
from tessera.operators import gram as GR
from tessera.operators import model as MD
from tessera.operators import permute as PM
from tessera.operators import sample as SA
from tessera.plans.registry import load, query
from tessera.plans.sqlgen import mix64
from tessera.session import scratch_path
from tessera.sources import tracking as TR

FEATURES = ["value", "log_value", "hour", "weekday", "k", "user_events", "user_avg_value"]
KEY, LABEL = "event_id", "label"
# The reference's baseline parameters where they are not defaults.
ARENA = {
    "logistic": {"C": 1.0},
    "random_forest": {"max_depth": 5},
    "gbt": {"max_depth": 3, "learning_rate": 0.1},
    "linear_svc": {},
    "decision_tree": {"max_depth": 4},
}
# The searched space: strength, and the reducer jointly.
SEARCH = {"C": ("log", 1e-4, 1e2), "reducer_method": ("cat", ["none", "pca", "lda"]), "reducer_n": ("int", 2, 7)}
TRIALS = 30
# A scorer of fixed coefficients.
SCORED = ["value", "hour", "weekday"]
SCORE_SQL = "CAST(0.01 AS DOUBLE) * value - CAST(0.05 AS DOUBLE) * hour + CAST(0.2 AS DOUBLE) * weekday"


def ml_table(spark, sf):
    """Event features; the user statistics table is one row per user and is
    joined on ``user_id`` (AQE broadcasts it when small)."""
    ev = load(spark, sf, "events")
    users = SA.stratified_split(ev.withColumn(LABEL, (F.col("event_type") == "purchase").cast("int")), LABEL, KEY, 0.2, 42) \
        .where("NOT is_test").groupBy("user_id").agg(F.count(F.lit(1)).alias("user_events"),
                                      F.avg("value").alias("user_avg_value"))
    d = ev.join(users, "user_id", "left")
    return d.select(
        KEY, F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias(LABEL),
        "value", F.log1p(F.when(F.col("value") < 0, 0.0).otherwise(F.col("value"))).alias("log_value"),
        F.hour("ts").cast("double").alias("hour"), F.dayofweek("ts").cast("double").alias("weekday"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.coalesce("user_events", F.lit(0)).cast("double").alias("user_events"), "user_avg_value")


def train_table(spark, sf):
    train, _ = EX.prepare(ml_table(spark, sf), LABEL, KEY, 0.2, 5, 42)
    return train


def _pipe(model, params=None, **kw):
    return MD.build_pipeline(model, FEATURES, params if params is not None else ARENA[model], LABEL, "weight", **kw)


def _train(spark, sf):
    """The kept training table; the table it was cut from is released."""
    train, _, df = EX.kept_parts(ml_table(spark, sf), LABEL, KEY, 0.2, 5, 42)
    train.count()
    df.unpersist()
    return train


def _kept(spark, sf, work):
    """``work(train)`` over the kept training table, as a small result table."""
    train = _train(spark, sf)
    try:
        return MD.small(work(train))
    finally:
        train.unpersist()


def _cv(train, model, params=None):
    metrics, oof = MD.cross_validate(_pipe(model, params), train, KEY, LABEL, "fold", model)
    metrics = MD.small(metrics)
    oof.unpersist()
    return metrics


def _arena(train, models, parallelism=2):
    ranking, oofs = MD.arena({m: _pipe(m) for m in models}, train, KEY, LABEL, "fold", parallelism=parallelism)
    ranking = MD.small(ranking)
    for o in oofs.values():
        o.unpersist()
    return ranking


@query("cv01_cross_validate")
def cross_validate(spark, sf):
    """CV-1 + ML-1/ML-2: per-fold metrics of the balanced logistic pipeline."""
    return _kept(spark, sf, lambda train: _cv(train, "logistic"))


@query("cv02_arena")
def arena(spark, sf):
    """CV-2 + ML-2..6 + MT-6 + WN-3: CV ranking of the five model families."""
    return _kept(spark, sf, lambda train: _arena(train, ARENA))


@query("cv03_grid_search")
def grid_search(spark, sf):
    """CV-3: exhaustive grid over the decision tree."""
    return _kept(spark, sf, lambda train: MD.grid_search(
        "decision_tree", {"max_depth": [3, 5], "min_samples_leaf": [1, 20], "criterion": ["gini", "entropy"]},
        train, FEATURES, KEY, LABEL, "fold", "weight", parallelism=2))


@query("cv09_tune_f1")
def tune_f1(spark, sf):
    """CV-3 on Spark's tuning layer: the tree's grid ranked by mean F1."""
    return _kept(spark, sf, lambda train: FO.tune(_pipe("decision_tree"), {
        "maxDepth": [3, 5], "minInstancesPerNode": [1, 20]}, train, "f1", LABEL, "fold")[1])


@query("cv04_random_search")
def random_search(spark, sf):
    """CV-4: seeded random search of C with the reducer searched jointly."""
    return _kept(spark, sf, lambda train: MD.random_search(
        "logistic", SEARCH, TRIALS, train, FEATURES, KEY, LABEL, "fold", "weight", 42, parallelism=4, baseline_auc=0.5))


@query("cv05_soft_vote")
def soft_vote(spark, sf):
    """CV-5: weights 1..5 for logistic + forest, all 25 vectors in one job."""
    def work(train):
        oofs = {m: MD.cross_validate(_pipe(m), train, KEY, LABEL, "fold", m)[1] for m in ("logistic", "random_forest")}
        out = MD.small(MD.soft_vote(oofs, KEY))
        for o in oofs.values():
            o.unpersist()
        return out
    return _kept(spark, sf, work)


@query("cv07_holdout")
def holdout(spark, sf):
    """CV-7 + MT-7: refit on all training rows, evaluate the holdout."""
    train, test = EX.prepare(ml_table(spark, sf), LABEL, KEY, 0.2, 5, 42)
    return MD.holdout_evaluate(MD.fit_pipeline(_pipe("logistic"), train), test, LABEL)


@query("cv08_run_experiment")
def run_experiment(spark, sf):
    """CV-8: the full experiment; returns its ranking, the vote among the
    entrants, next to the champion's holdout figures."""
    cfg = {"models": ARENA, "search": {"logistic": (SEARCH, TRIALS)}, "parallelism": 4,
           "registry": scratch_path(spark, "experiment"), "name": "event_risk"}
    r = EX.run_experiment(ml_table(spark, sf), FEATURES, LABEL, KEY, cfg)
    # one row per entrant, one summary row
    return r["ranking"].join(F.broadcast(r["summary"]))


def _fitted(spark, sf, model):
    train = _train(spark, sf)
    fitted = MD.fit_pipeline(_pipe(model), train)
    train.unpersist()
    return fitted


@query("ml07_linear_weights")
def linear_weights(spark, sf):
    return MD.linear_weights(_fitted(spark, sf, "linear_svc"))


@query("ml08_tree_rules")
def tree_rules(spark, sf):
    return MD.tree_rules(_fitted(spark, sf, "decision_tree"))


@query("ml09_feature_importance")
def feature_importance(spark, sf):
    return MD.feature_importance(_fitted(spark, sf, "random_forest"))


@query("ml10_permutation_importance")
def permutation_importance(spark, sf):
    """ML-10: every feature on the whole table, the default repeats."""
    return MD.permutation_importance(_fitted(spark, sf, "logistic"), ml_table(spark, sf), FEATURES, KEY, LABEL)


def _shuffled_scores_sql(features: list[str], repeats: int, seed: int = 42) -> str:
    """Twin of ``permute.shuffled_copies`` over ``d(event_id, label, features...)``: one
    row per slot and event.  Three passes through the network suffice where the grid
    has at most two spare cells, as for the row counts of the given tables."""
    slots = [(i * repeats + r, i, *PM.round_keys(i * repeats + r, seed)) for i in range(len(features)) for r in range(repeats)]
    ctes, last = [], "x0"
    for walk in range(3):
        first = last
        ctes.append(f"w{walk} AS (SELECT *, y // b AS pl, y % b AS pr FROM {first})")
        last = f"w{walk}"
        for r in range(PM.ROUNDS):
            moved, other, side = ("pr", "pl", "b") if r % 2 == 0 else ("pl", "pr", "a")
            h = mix64(f"xor({other}, k{r})", PM.ROUND_SEED)
            ctes.append(f"w{walk}_{r} AS (SELECT * REPLACE (({moved} + {h}) % {side} AS {moved}) FROM {last})")
            last = f"w{walk}_{r}"
        again = "pl * b + pr" if walk == 0 else "CASE WHEN y >= n THEN pl * b + pr ELSE y END"
        ctes.append(f"x{walk + 1} AS (SELECT * EXCLUDE (pl, pr) REPLACE ({again} AS y) FROM {last})")
        last = f"x{walk + 1}"
    keys = ", ".join(f"k{r}" for r in range(PM.ROUNDS))
    swapped = ", ".join(f"CASE WHEN g.feature = {i} THEN g.{c} ELSE p.{c} END AS {c}" for i, c in enumerate(features))
    return f"""
p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM d),
size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM d),
sides AS (SELECT n, unnest(range(greatest(1, root // 2), root + 1)) AS a FROM size),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM sides ORDER BY (a - n % a) % a, a DESC LIMIT 1),
slots(slot, feature, {keys}) AS (VALUES {', '.join(str(s) for s in slots)}),
x0 AS (SELECT p.*, slots.*, grid.*, pos AS y FROM p, slots, grid),
{', '.join(ctes)},
copies AS (
  SELECT g.slot, g.feature, p.event_id, p.label, {swapped} FROM {last} g JOIN p ON p.pos = g.y
  UNION ALL SELECT {PM.AS_IS}, {PM.AS_IS}, event_id, label, {', '.join(features)} FROM p)"""


@query("ml10_permutation_scorer", f"""
WITH d AS (SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS label, value, hour(ts) AS hour, dayofweek(ts) + 1 AS weekday FROM events),
{_shuffled_scores_sql(SCORED, 5)},
s AS (SELECT slot, feature, label, {SCORE_SQL} AS s FROM copies),
c AS (SELECT slot, feature, s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
      FROM s WHERE s IS NOT NULL GROUP BY slot, feature, s),
u AS (SELECT *, sum(neg) OVER (PARTITION BY slot ORDER BY s) - neg AS below FROM c),
auc AS (SELECT slot, feature, sum(pos * (below + neg / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc FROM u GROUP BY slot, feature),
i AS (SELECT a.feature, z.auc - a.auc AS fall FROM auc a, auc z WHERE z.slot = {PM.AS_IS} AND a.slot <> {PM.AS_IS})
SELECT CASE feature {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(SCORED))} END AS feature,
  avg(fall) AS importance_mean, stddev_samp(fall) AS importance_std FROM i GROUP BY feature
""")
def permutation_scorer(spark, sf):
    """ML-10 of a fixed scorer: every shuffle of every feature over all events."""
    d = load(spark, sf, "events").select(KEY, F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias(LABEL),
                                         "value", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("weekday"))
    return MD.permutation_importance(lambda x: x.withColumn("score", F.expr(SCORE_SQL)), d, SCORED, KEY, LABEL,
                                     rows_per_bucket=1 << 16)


def _emb(spark, sf):
    return load(spark, sf, "embeddings")


@query("ml11_pca_2d")
def pca_2d(spark, sf):
    """ML-11 / ML-15: two principal-component scores per embedding."""
    return MD.pca_scores(_emb(spark, sf), "embedding", "vec_id", 2)


@query("ml12_fisher")
def fisher(spark, sf):
    """ML-12: first Fisher discriminant of the embedding classes."""
    return MD.fisher_projection(_emb(spark, sf), "embedding", "label", "vec_id")


@query("ml12_class_scatter", """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i
           FROM embeddings WHERE label IS NOT NULL),
c AS (SELECT a.label, a.i, b.i AS j, count(*) * covar_pop(a.x, b.x) AS s
      FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2, 3)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(s) AS within FROM c GROUP BY 1, 2
""")
def class_scatter(spark, sf):
    """ML-12: the pooled within-class products that the Fisher fit solves, for all
    classes in one pass."""
    e = load(spark, sf, "embeddings").where("label IS NOT NULL")
    return GR.class_scatter(e, GR.vector_of(e, "embedding"), F.col("label"))[0]


@query("ml12_fisher_2d", """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
                  l_quantity AS a, l_discount AS b FROM lineitem),
c AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS caa,
             covar_samp(a, b) AS cab, covar_samp(b, b) AS cbb FROM d GROUP BY label),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS N, CAST(count(*) AS DOUBLE) AS K, sum(n * ma) / sum(n) AS mua,
             sum(n * mb) / sum(n) AS mub, sum((n - 1) * caa) AS s11, sum((n - 1) * cab) AS s12,
             sum((n - 1) * cbb) AS s22,
             max(CASE WHEN label = 1 THEN ma END) - max(CASE WHEN label = 0 THEN ma END) AS da,
             max(CASE WHEN label = 1 THEN mb END) - max(CASE WHEN label = 0 THEN mb END) AS db FROM c),
w0 AS (SELECT *, (s22 * da - s12 * db) / (s11 * s22 - s12 * s12) AS wa,
              (s11 * db - s12 * da) / (s11 * s22 - s12 * s12) AS wb FROM t),
w1 AS (SELECT *, sqrt((wa * wa * s11 + 2 * wa * wb * s12 + wb * wb * s22) / (N - K)) AS sc FROM w0),
w AS (SELECT mua, mub, wa / sc * (CASE WHEN abs(wa / sc) > 1e-12 THEN sign(wa) ELSE sign(wb) END) AS ua,
             wb / sc * (CASE WHEN abs(wa / sc) > 1e-12 THEN sign(wa) ELSE sign(wb) END) AS ub FROM w1)
SELECT l_orderkey, l_linenumber, label, (a - mua) * ua + (b - mub) * ub AS lda_0 FROM d, w
""")
def fisher_2d(spark, sf):
    """ML-12 in its two-feature form (exact twin): Fisher direction of the
    returned-line label over quantity and discount, unit pooled
    within-class variance, first component positive."""
    li = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        "l_quantity", "l_discount")
    from tessera.operators.model import FisherDirection, to_vector
    from pyspark.ml.functions import vector_to_array
    d = to_vector(li, ["l_quantity", "l_discount"])
    m = FisherDirection(inputCol="_v", outputCol="_l", labelCol="label").fit(d)
    return m.transform(d).select("l_orderkey", "l_linenumber", "label",
                                 vector_to_array(F.col("_l"))[0].alias("lda_0"))


@query("ml13_kmeans_scan")
def kmeans_scan(spark, sf):
    return MD.kmeans_scan(_emb(spark, sf), "embedding", (2, 3, 4, 5, 6))


@query("ml14_assign_clusters")
def assign_clusters(spark, sf):
    return MD.assign_clusters(ml_table(spark, sf), ["value", "k", "user_events"], KEY, k=3)


@query("sc01_score")
def score(spark, sf):
    """SC-1 (+IO-10/11): fit, register, load the latest version, score every
    event with the 0.30 triage threshold and rule messages."""
    base = scratch_path(spark, "registry")
    train, test, df = EX.kept_parts(ml_table(spark, sf), LABEL, KEY, 0.2, 5, 42)
    model = MD.fit_pipeline(_pipe("logistic"), train)
    train.unpersist()
    held = MD.holdout_evaluate(model, test, LABEL).first()
    run_id = TR.append_run(spark, base, "logistic", "final", ARENA["logistic"],
                           {"roc_auc": held["roc_auc"], "recall": held["recall"]})
    df.unpersist()
    TR.save_model(spark, base, "event_risk", model, run_id)
    latest = TR.load_model(spark, base, "event_risk")
    rules = [("high value", F.col("value") > 100), ("frequent user", F.col("user_events") > 20),
             ("night", F.col("hour") < 6)]
    return MD.score(latest, ml_table(spark, sf), 0.30, rules=rules, keep=[KEY])


@query("io12_model_performance")
def model_performance(spark, sf):
    """IO-10..12: two registered versions; the latest one's run metrics
    (absent recall -> default 0.0)."""
    base = scratch_path(spark, "registry")
    train = _train(spark, sf)
    for c in (1.0, 0.1):
        auc = _cv(train, "logistic", {"C": c}).agg(F.avg("roc_auc")).first()[0]
        run = TR.append_run(spark, base, "logistic", "final", {"C": c}, {"roc_auc": auc})
        TR.save_model(spark, base, "event_risk", MD.fit_pipeline(_pipe("logistic", {"C": c}), train), run)
    train.unpersist()
    return TR.model_performance(spark, base, "event_risk")


@query("wn03_rank_models")
def rank_models(spark, sf):
    """WN-3 / CV-6: ranking of the arena and the selected best row."""
    return _kept(spark, sf, lambda train: MD.select_best(_arena(train, ("logistic", "decision_tree"))))


@query("fe09_categorical_branch")
def categorical_branch(spark, sf):
    """FE-9 / IS-8: numeric + categorical (event type of the previous
    feature set: the ``props`` bucket) branches in one pipeline; the weights
    of the fitted linear model name every one-hot slot."""
    d = ml_table(spark, sf).join(
        load(spark, sf, "events").select(KEY, F.when(F.col("value") > 100, "high").when(F.col("value") > 20, "mid")
                                              .otherwise("low").alias("value_band")), KEY)
    train, _ = EX.prepare(d, LABEL, KEY, 0.2, 5, 42)
    pipe = MD.build_pipeline("logistic", FEATURES, ARENA["logistic"], LABEL, "weight",
                             categorical=["value_band"])
    return MD.linear_weights(MD.fit_pipeline(pipe, train))
