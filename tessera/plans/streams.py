"""Streaming queries (ST-*): the driver's ``events`` file is the stream
source, processed with ``trigger(availableNow=True)`` into sinks under the
shared checkpoint directory; each query returns the sink's batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import decide
from tessera.plans.quality import _suite_sql
from tessera.plans.registry import load, query
from tessera.session import scratch_path
from tessera.streaming import streams as SS

EVENT_TYPES_OK = ["click", "view", "purchase", "signup"]
# A contract for the event stream (the "error" type and large
# values are expected to fail it).
EVENT_SUITE = {
    "table_expectations": [{"type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 1000000000}}],
    "column_expectations": {
        "event_id": [{"type": "expect_column_values_to_not_be_null"}],
        "event_type": [{"type": "expect_column_values_to_be_in_set", "kwargs": {"value_set": EVENT_TYPES_OK, "mostly": 0.9}}],
        "value": [{"type": "expect_column_values_to_be_between", "kwargs": {"min_value": 0, "max_value": 300, "mostly": 0.99}}],
    },
}
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _events_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return SS.stream_source(spark, sf, schema, glob="events.parquet")


@query("st01_windowed_metrics", """
WITH s AS (SELECT date_trunc('day', ts) AS ws, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
                  value / (value + 50.0) AS prob, CASE WHEN value / (value + 50.0) >= 0.5 THEN 1 ELSE 0 END AS pred
           FROM events),
b AS (SELECT ws, CAST(least(floor(prob * 100), 99) AS INTEGER) AS bucket, count_if(label = 1) AS pos,
             count_if(label = 0) AS neg, count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp,
             count_if(label = 0 AND pred = 0) AS tn, count_if(label = 1 AND pred = 0) AS fn FROM s GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY ws ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM b),
g AS (SELECT ws, sum(pos * (nb + neg / 2.0)) AS u, sum(pos) AS P, sum(neg) AS N, sum(tp) AS tp, sum(fp) AS fp,
             sum(tn) AS tn, sum(fn) AS fn FROM c GROUP BY ws)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       CAST(tp + fp + tn + fn AS BIGINT) AS n,
       CASE WHEN P > 0 AND N > 0 THEN u / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) ELSE 0.5 END AS roc_auc,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
       CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END AS accuracy
FROM g
""")
def windowed_metrics(spark, sf):
    """ST-1: daily event-time windows, 1-day watermark."""
    ev = _events_stream(spark, sf)
    prob = F.col("value") / (F.col("value") + F.lit(50.0))
    scored = ev.select("ts", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
                       prob.alias("prob"), decide(prob, 0.5).alias("pred"))
    m = SS.windowed_metrics(spark, scored, "ts", "1 day", "1 day", "label", "pred", "prob",
                            sink=scratch_path(spark, "st1-sink"), checkpoint=scratch_path(spark, "st1-ckpt"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return m.withColumns({"window_start": F.date_format("window_start", fmt),
                          "window_end": F.date_format("window_end", fmt)})


@query("st02_quality_stream", f"""
SELECT *, CAST(0 AS INTEGER) AS batch_id FROM ({_suite_sql(EVENT_SUITE, "events", EVENT_COLUMNS)}) s
""")
def quality_stream(spark, sf):
    """ST-2: suite per micro-batch (one file = one batch here)."""
    return SS.quality_stream(spark, _events_stream(spark, sf), EVENT_SUITE,
                             sink=scratch_path(spark, "st2-sink"), checkpoint=scratch_path(spark, "st2-ckpt"))


@query("st03_ingest_incremental", "SELECT * FROM events")
def ingest_incremental(spark, sf):
    """ST-3: two runs over the same input and checkpoint — the second one
    ingests nothing (idempotent); the sink holds every event once."""
    schema = load(spark, sf, "events").schema
    dst, ck = scratch_path(spark, "st3-sink"), scratch_path(spark, "st3-ckpt")
    SS.ingest_incremental(spark, sf, dst, schema, ck, glob="events.parquet")
    second = SS.ingest_incremental(spark, sf, dst, schema, ck, glob="events.parquet")
    if second["rows"] != 0:
        raise RuntimeError("incremental ingest re-read input")
    return spark.read.schema(schema).parquet(dst)
