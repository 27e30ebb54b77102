"""Metric and monitoring queries (MT-*, MO-*) on a scored ``events`` table.

Scoring rule (a deterministic expression both engines repeat): label =
``event_type = 'purchase'``, probability = ``value / (value + 50)``,
decision = probability >= 0.5; a batch is the event day, or contiguous
key batches as in the reference's monitoring page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import decide
from tessera.operators import metrics as MT
from tessera.operators import monitor as MO
from tessera.operators import sample as SA
from tessera.plans.registry import load, query
from tessera.plans.sqlgen import mix64

RPB = 4096

SCORED_SQL = ("(SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, "
              "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, "
              "value / (value + 50.0) AS prob, "
              "CASE WHEN value / (value + 50.0) >= 0.5 THEN 1 ELSE 0 END AS pred FROM events)")


def scored_events(spark, sf):
    ev = load(spark, sf, "events")
    prob = F.col("value") / (F.col("value") + F.lit(50.0))
    return ev.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                     F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
                     prob.alias("prob"), decide(prob, 0.5).alias("pred"))


def counts_sql(src, by=()):
    b = ", ".join(by)
    sel = (b + ", ") if by else ""
    grp = f" GROUP BY {b}" if by else ""
    return (f"SELECT {sel}CAST(count_if(label = 1 AND pred = 1) AS BIGINT) AS tp, "
            f"CAST(count_if(label = 0 AND pred = 1) AS BIGINT) AS fp, "
            f"CAST(count_if(label = 0 AND pred = 0) AS BIGINT) AS tn, "
            f"CAST(count_if(label = 1 AND pred = 0) AS BIGINT) AS fn, count(*) AS n "
            f"FROM {src} s WHERE label IS NOT NULL AND pred IS NOT NULL{grp}")


def auc_sql(src, by=()):
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    b = ", ".join(by)
    sel = (b + ", ") if by else ""
    grp = f" GROUP BY {b}" if by else ""
    return f"""SELECT {sel}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
         THEN sum(pos * (nb + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) ELSE 0.5 END AS roc_auc
FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT {sel}prob AS sc, count_if(label = 1) AS pos, count_if(label = 0) AS neg
            FROM {src} s WHERE prob IS NOT NULL AND label IS NOT NULL AND pred IS NOT NULL GROUP BY {sel}prob) g) c{grp}"""


def div0(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def metrics_sql(src, by=(), cols=("roc_auc", "f1", "precision", "recall", "accuracy")):
    rates = {"f1": div0("2 * tp", "2 * tp + fp + fn"), "precision": div0("tp", "tp + fp"),
             "recall": div0("tp", "tp + fn"), "accuracy": div0("tp + tn", "tp + fp + tn + fn"),
             "roc_auc": "roc_auc"}
    b = ", ".join(f"c.{x}" for x in by)
    sel = (b + ", ") if by else ""
    join = (f"JOIN ({auc_sql(src, by)}) a ON " + " AND ".join(f"c.{x} = a.{x}" for x in by)) if by \
        else f", ({auc_sql(src, by)}) a"
    return f"SELECT {sel}n, {', '.join(f'{rates[k]} AS {k}' for k in cols)} FROM ({counts_sql(src, by)}) c {join}"


@query("mt01_confusion", counts_sql(SCORED_SQL))
def confusion(spark, sf):
    return MT.confusion(scored_events(spark, sf), "label", "pred")


@query("mt02_binary_metrics", metrics_sql(SCORED_SQL))
def binary_metrics(spark, sf):
    return MT.binary_metrics(scored_events(spark, sf), "label", "pred", "prob", rows_per_bucket=RPB)


@query("mt03_roc_auc_by_day", auc_sql(SCORED_SQL, ["day"]))
def roc_auc_by_day(spark, sf):
    return MT.roc_auc(scored_events(spark, sf), "prob", "label", by=["day"], rows_per_bucket=256)


@query("mt03_auc_summary", f"""
WITH g AS (SELECT day, least(CASE WHEN prob >= 1 THEN 511 WHEN prob <= 0 THEN 0
                        ELSE CAST(floor(prob * 512) AS INTEGER) END, 511) AS bin,
                  count_if(label = 1) AS pos, count_if(label = 0) AS neg
           FROM {SCORED_SQL} s WHERE prob IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM g),
t AS (SELECT day, sum(pos * (nb + neg / 2.0)) AS u, sum(CAST(pos AS DOUBLE) * neg) AS same,
             CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) AS pairs FROM c GROUP BY day)
SELECT day, CASE WHEN pairs > 0 THEN u / pairs ELSE 0.5 END AS roc_auc,
       CASE WHEN pairs > 0 THEN same / 2.0 / pairs ELSE 0.0 END AS max_error FROM t
""")
def auc_summary(spark, sf):
    """MT-3 from mergeable score summaries with its error bound."""
    return MT.summary_auc(MT.score_summary(scored_events(spark, sf), "prob", "label", ["day"], 512), ["day"])


@query("mt04_roc_curve", f"""
WITH g AS (SELECT prob AS threshold, count_if(label = 1) AS pos, count_if(label = 0) AS neg
           FROM {SCORED_SQL} s WHERE prob IS NOT NULL GROUP BY prob),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM g)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {div0('tp', 'P')} AS tpr, {div0('fp', 'N')} AS fpr,
       {div0('tp', 'tp + fp')} AS precision, {div0('tp', 'P')} AS recall
FROM c, t
""")
def roc_curve(spark, sf):
    return MT.roc_curve(scored_events(spark, sf), "prob", "label", rows_per_bucket=RPB)


@query("mt05_classification_report", f"""
WITH c AS ({counts_sql(SCORED_SQL)}),
r AS (SELECT {div0('tn', 'tn + fn')} AS p0, {div0('tn', 'tn + fp')} AS r0, {div0('2 * tn', '2 * tn + fn + fp')} AS f0,
             {div0('tp', 'tp + fp')} AS p1, {div0('tp', 'tp + fn')} AS r1, {div0('2 * tp', '2 * tp + fp + fn')} AS f1,
             tn + fp AS s0, tp + fn AS s1 FROM c)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM r
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(s0 + s1 AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', {div0('p0 * s0 + p1 * s1', 's0 + s1')}, {div0('r0 * s0 + r1 * s1', 's0 + s1')},
                 {div0('f0 * s0 + f1 * s1', 's0 + s1')}, CAST(s0 + s1 AS BIGINT) FROM r
""")
def classification_report(spark, sf):
    return MT.classification_report(scored_events(spark, sf), "label", "pred")


FOLDED_SQL = (f"(SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY h, event_id) - 1) * 5 "
              f"// count(*) OVER (PARTITION BY label) AS INTEGER) AS fold "
              f"FROM (SELECT *, {mix64('event_id', 42)} AS h FROM {SCORED_SQL} s0) s1)")


def folded_events(spark, sf):
    return SA.stratified_folds(scored_events(spark, sf), "label", "event_id", 5, 42)


@query("mt06_aggregate_folds", f"""
SELECT {", ".join(f"avg({m}) AS cv_{m}_mean, stddev_samp({m}) AS cv_{m}_std" for m in MT.METRICS)}
FROM ({metrics_sql(FOLDED_SQL, ["fold"])}) f
""")
def aggregate_folds(spark, sf):
    """MT-6 over per-fold metrics of stratified folds (SP-3 + MT-2)."""
    per_fold = MT.binary_metrics(folded_events(spark, sf), "label", "pred", "prob", by=["fold"],
                                 rows_per_bucket=RPB)
    return MT.aggregate_folds(per_fold, by=())


@query("mt07_robustness", f"""
WITH m AS ({metrics_sql(FOLDED_SQL, ["fold"])})
SELECT cv_auc, holdout_auc, cv_auc - holdout_auc AS delta,
       CASE WHEN cv_auc - holdout_auc < 0.03 THEN 'good' WHEN cv_auc - holdout_auc < 0.08 THEN 'moderate'
            ELSE 'poor' END AS diagnosis
FROM (SELECT avg(CASE WHEN fold < 4 THEN roc_auc END) AS cv_auc, max(CASE WHEN fold = 4 THEN roc_auc END) AS holdout_auc FROM m) x
""")
def robustness(spark, sf):
    """MT-7: folds 0-3 as CV estimate, fold 4 as holdout."""
    per_fold = MT.binary_metrics(folded_events(spark, sf), "label", "pred", "prob", by=["fold"],
                                 rows_per_bucket=RPB)
    r = per_fold.agg(F.avg(F.when(F.col("fold") < 4, F.col("roc_auc"))).alias("cv_auc"),
                     F.max(F.when(F.col("fold") == 4, F.col("roc_auc"))).alias("holdout_auc"))
    return r.select("cv_auc", "holdout_auc", (F.col("cv_auc") - F.col("holdout_auc")).alias("delta"),
                    MT.robustness("cv_auc", "holdout_auc").alias("diagnosis"))


MO_COLS = ("roc_auc", "f1", "recall", "accuracy")


@query("mo01_batch_metrics", metrics_sql(SCORED_SQL, ["day"], MO_COLS))
def batch_metrics(spark, sf):
    return MO.batch_metrics(scored_events(spark, sf), "day", "label", "pred", "prob")


KEYED_SQL = (f"(SELECT * FROM (SELECT *, CAST(i // (cnt // 10) + 1 AS INTEGER) AS batch FROM "
             f"(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS cnt FROM {SCORED_SQL} s0) s1 "
             f"WHERE i < (cnt // 10) * 10) s2)")


@query("mo01_batch_metrics_keyed", metrics_sql(KEYED_SQL, ["batch"], MO_COLS))
def batch_metrics_keyed(spark, sf):
    """MO-1 over 10 contiguous batches in key order (WN-2), remainder dropped."""
    b = SA.assign_batches(scored_events(spark, sf), 10, "event_id", remainder="drop")
    return MO.batch_metrics(b, "batch", "label", "pred", "prob")


@query("mo02_metric_trend", f"""
SELECT *, {", ".join(f"avg({m}) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {m}_ma" for m in MO_COLS)}
FROM ({metrics_sql(SCORED_SQL, ["day"], MO_COLS)}) b
""")
def metric_trend(spark, sf):
    return MO.metric_trend(MO.batch_metrics(scored_events(spark, sf), "day", "label", "pred", "prob"), "day", 3)


@query("mo03_overall_kpis", f"""
SELECT m.*, c.tp, c.fp, c.tn, c.fn FROM ({metrics_sql(SCORED_SQL, (), MO_COLS)}) m, ({counts_sql(SCORED_SQL)}) c
""")
def overall_kpis(spark, sf):
    return MO.overall_kpis(scored_events(spark, sf), "label", "pred", "prob")


# ------------------------------------------------ vote arithmetic (CV-5/6) --

def _two_scorers(spark, sf):
    """Two deterministic 'models' over the folded events: the value score and
    a score from the JSON property ``k``; out-of-fold tables as the model
    arena produces them (key, fold, label, score)."""
    d = folded_events(spark, sf)
    ev = load(spark, sf, "events").select("event_id", F.coalesce(
        F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("k"))
    d = d.join(ev, "event_id")
    a = d.select("event_id", "fold", "label", F.col("prob").alias("score"))
    b = d.select("event_id", "fold", "label", (F.col("k") / (F.col("k") + F.lit(50.0))).alias("score"))
    return {"value": a, "k": b}


VOTE_SQL = f"""
(SELECT s.event_id, s.fold, s.label, w_value, w_k,
        (w_value * s.prob + w_k * (coalesce(CAST(json_extract_string(e.props, '$.k') AS DOUBLE), 0.0)
          / (coalesce(CAST(json_extract_string(e.props, '$.k') AS DOUBLE), 0.0) + 50.0))) / (w_value + w_k) AS prob
 FROM {FOLDED_SQL} s JOIN events e ON s.event_id = e.event_id,
      (SELECT a.w AS w_value, b.w AS w_k FROM (SELECT unnest([1, 2, 3, 4, 5]) AS w) a,
                                            (SELECT unnest([1, 2, 3, 4, 5]) AS w) b) ws)
"""
VOTE_SCORED = f"(SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM {VOTE_SQL} v0)"
VOTE_RESULT_SQL = f"""
SELECT w_value, w_k, {", ".join(f"avg({m}) AS cv_{m}_mean, stddev_samp({m}) AS cv_{m}_std" for m in MT.METRICS)}
FROM ({metrics_sql(VOTE_SCORED, ["w_value", "w_k", "fold"])}) f GROUP BY w_value, w_k
"""


@query("cv05_vote_arithmetic", VOTE_RESULT_SQL)
def vote_arithmetic(spark, sf):
    """CV-5 on deterministic scores: every weight vector 1..5 x 1..5 of the
    weighted probability mean, evaluated per fold in one job."""
    from tessera.operators.model import soft_vote
    return soft_vote(_two_scorers(spark, sf), "event_id")


@query("cv06_select_best", f"""
SELECT * FROM ({VOTE_RESULT_SQL}) r ORDER BY cv_roc_auc_mean DESC, w_value, w_k LIMIT 1
""")
def select_best(spark, sf):
    """CV-6: the best weight vector by mean CV AUC (ties by weights)."""
    from tessera.operators.model import soft_vote
    v = soft_vote(_two_scorers(spark, sf), "event_id")
    return v.orderBy(F.desc("cv_roc_auc_mean"), "w_value", "w_k").limit(1)


@query("wn03_rank_batches", f"""
SELECT *, CAST(row_number() OVER (ORDER BY roc_auc DESC NULLS LAST, day) AS INTEGER) AS rank
FROM ({metrics_sql(SCORED_SQL, ["day"], MO_COLS)}) b
""")
def rank_batches(spark, sf):
    """WN-3: ranking table (best first, ties by name) over the daily batch
    metrics."""
    m = MO.batch_metrics(scored_events(spark, sf), "day", "label", "pred", "prob")
    return SA.rank_models(m, "roc_auc", name="day")
