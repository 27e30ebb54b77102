"""Saved models and feature stages applied to raw rows (IO-10, SC-1, CV-5, FE-13/14,
IS-4/5) and the keyed lookup of clusters (JN-3).  Members have fixed coefficients,
so that everything a saved model returns has a DuckDB twin."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import lookup as LK
from tessera.operators import model as MD
from tessera.operators import stages as SG
from tessera.operators.vote import LinearScorer, VoteModel
from tessera.plans.eda import MISSING_SQL, lineitem_with_missing
from tessera.plans.features import FEATURE_CONFIG, SCORING_SQL
from tessera.plans.registry import load, query
from tessera.session import scratch_path
from tessera.sources import tracking as TR

KEY = "event_id"
# (inputs, weights, intercept) of the two members, and their votes
MEMBERS = ((("value", "hour"), (0.01, -0.05), -0.8), (("value", "weekday"), (-0.004, 0.2), 0.1))
VOTES = (2.0, 1.0)
_INPUT_SQL = "SELECT event_id, value, hour(ts) AS hour, dayofweek(ts) + 1 AS weekday FROM events"


def _inputs(spark, sf):
    return load(spark, sf, "events").select(KEY, "value", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("weekday"))


def _sigmoid(member) -> str:
    cols, weights, intercept = member
    return f"1 / (1 + exp(-({intercept} + {' + '.join(f'{w} * {c}' for c, w in zip(cols, weights))})))"


def _rules():
    return [("high value", F.col("value") > 100), ("night", F.col("hour") < 6)]


_FACTORS_SQL = """CASE WHEN value > 100 AND hour < 6 THEN 'high value|night' WHEN value > 100 THEN 'high value'
  WHEN hour < 6 THEN 'night' ELSE 'no risk factor' END"""


def _registered(spark, model, name):
    """The model as the store gives it back."""
    base = scratch_path(spark, "registry")
    TR.save_model(spark, base, name, model, TR.append_run(spark, base, name, "final", {}, {}))
    return TR.load_model(spark, base, name)


@query("sc02_score_vote", f"""
WITH d AS ({_INPUT_SQL}),
p AS (SELECT *, ({VOTES[0]} * ({_sigmoid(MEMBERS[0])}) + {VOTES[1]} * ({_sigmoid(MEMBERS[1])})) / {sum(VOTES)} AS probability FROM d)
SELECT event_id, probability, CAST(probability >= 0.3 AS INTEGER) AS decision FROM p
""")
def score_vote(spark, sf):
    """CV-5 / IO-10 / SC-1: a soft vote is registered as one model, loaded back
    and scores every event."""
    vote = VoteModel([(w, PipelineModel([LinearScorer(*m)])) for w, m in zip(VOTES, MEMBERS)])
    return MD.score(_registered(spark, vote, "vote"), _inputs(spark, sf), 0.30, keep=[KEY])


@query("sc03_score_linear", f"""
WITH d AS ({_INPUT_SQL}), p AS (SELECT *, {_sigmoid(MEMBERS[0])} AS probability FROM d)
SELECT event_id, probability, CAST(probability >= 0.3 AS INTEGER) AS decision, {_FACTORS_SQL} AS factors FROM p
""")
def score_linear(spark, sf):
    """SC-1 with fixed coefficients: probability, triage and matched rules."""
    model = _registered(spark, PipelineModel([LinearScorer(*MEMBERS[0])]), "linear")
    return MD.score(model, _inputs(spark, sf), 0.30, rules=_rules(), keep=[KEY])


@query("fe15_saved_features", SCORING_SQL)
def saved_features(spark, sf):
    """FE-13 / FE-14: the fitted feature stage is saved, loaded and takes raw rows."""
    li = load(spark, sf, "lineitem")
    model = Pipeline(stages=[SG.FeatureBuilder({**FEATURE_CONFIG, "features_to_keep": [
        *[c for c in FEATURE_CONFIG["features_to_keep"] if c not in ("is_heavy", "target_numeric")], "is_heavy"]})]).fit(li)
    return _registered(spark, model, "features").transform(li)


@query("is09_saved_preparation", f"""
WITH g AS (SELECT l_returnflag, median(l_discount) AS m FROM {MISSING_SQL} x WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag),
f AS (SELECT t.l_orderkey, t.l_linenumber, t.l_returnflag, t.l_quantity, coalesce(t.l_discount, g.m) AS l_discount
      FROM {MISSING_SQL} t LEFT JOIN g ON t.l_returnflag = g.l_returnflag),
s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_discount) AS md, stddev_samp(l_discount) AS sd FROM f)
SELECT l_orderkey, l_linenumber, l_returnflag, (l_quantity - mq) / (sq + 1e-9) AS l_quantity,
  (l_discount - md) / (sd + 1e-9) AS l_discount FROM f, s
""")
def saved_preparation(spark, sf):
    """IS-4 and IS-5 as stages of one pipeline, saved (the medians as a table) and
    loaded before they are applied."""
    d = lineitem_with_missing(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    model = Pipeline(stages=[SG.GroupMedianImputer("l_returnflag", "l_discount"),
                             SG.Standardizer(["l_quantity", "l_discount"])]).fit(d)
    return _registered(spark, model, "preparation").transform(d)


CENTRES = ((5.0, 3.0), (60.0, 12.0), (150.0, 20.0))
_AWAY = ["(value - {0}) * (value - {0}) + (hour - {1}) * (hour - {1})".format(*c) for c in CENTRES]


@query("jn03_row_cluster", f"""
WITH d AS ({_INPUT_SQL}), a AS (SELECT *, {", ".join(f"{x} AS d{i}" for i, x in enumerate(_AWAY))} FROM d WHERE value IS NOT NULL)
SELECT event_id, value, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM a
""")
def row_cluster(spark, sf):
    """JN-3: clusters, a table as long as the data, looked up by key; both sides
    lie in buckets of the key, so the join moves no row."""
    d = _inputs(spark, sf)
    labels = LK.nearest_centre(d, ["value", "hour"], CENTRES).where("cluster IS NOT NULL").select(KEY, "cluster")
    return LK.row_lookup(d.select(KEY, "value"), labels, KEY, 8)
