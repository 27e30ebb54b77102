"""Batch monitoring of a scored table (MO-1..3).

The reference slices a random sample into fake lots; here a batch is any
column of the scored table — an event-time day, or the contiguous key batches
of :func:`tessera.operators.sample.assign_batches`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import binary_metrics, confusion
from tessera.operators.sample import rolling_mean

MONITOR_METRICS = ["roc_auc", "f1", "recall", "accuracy"]


def batch_metrics(scored: DataFrame, batch: str, label: str, pred: str, prob: str | None) -> DataFrame:
    """MO-1: AUC, F1, recall, accuracy per batch — one grouped aggregate plus
    the per-batch AUC (partitioned by batch)."""
    m = binary_metrics(scored, label, pred, prob, by=[batch])
    return m.select(batch, "n", *MONITOR_METRICS)


def metric_trend(batch_table: DataFrame, batch: str, window: int = 3,
                 metrics: Sequence[str] = MONITOR_METRICS) -> DataFrame:
    """MO-2: trailing moving mean (``min_periods=1``) of each metric over the
    batch table (one row per batch)."""
    return rolling_mean(batch_table, list(metrics), batch, window)


def overall_kpis(scored: DataFrame, label: str, pred: str, prob: str | None) -> DataFrame:
    """MO-3: the same metrics over all rows plus the confusion counts."""
    m = binary_metrics(scored, label, pred, prob)
    c = confusion(scored, label, pred).first()
    return m.select("n", *MONITOR_METRICS).withColumns(
        {k: F.lit(int(c[k])).cast("long") for k in ("tp", "fp", "tn", "fn")})
