"""Grouped means, pivots and interaction tables (AG-9..11).

All are hash aggregates with map-side partial aggregation; the pivot always
receives explicit values so Spark does not run an extra distinct job, and
null keys are dropped first (pandas ``groupby`` / ``pivot_table`` drop them,
Spark would keep a null group).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import distinct_values


def _q(c: str):
    return F.col(f"`{c}`")


def _not_null(keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & _q(k).isNotNull()
    return cond


def group_mean(df: DataFrame, keys: Sequence[str], value: str,
               with_count: bool = True, alias: str = "mean") -> DataFrame:
    """AG-9: mean of ``value`` by n-way ``keys`` (null keys dropped)."""
    aggs = [F.avg(_q(value)).alias(alias)]
    if with_count:
        aggs.append(F.count(_q(value)).alias("n"))
    return df.where(_not_null(keys)).groupBy(*[_q(k).alias(k) for k in keys]).agg(*aggs)


def pivot_mean(df: DataFrame, index: str, columns: str, value: str,
               values: Sequence | None = None, max_values: int = 1000) -> DataFrame:
    """AG-10: cross-tab of means, one output column per ``columns`` value.

    ``values`` fixes (and orders) the output columns — pass the bin labels in
    label order; when omitted they are discovered (sorted, capped)."""
    if values is None:
        values = distinct_values(df, columns, max_values)
    return (df.where(_not_null([index, columns]))
              .groupBy(_q(index).alias(index))
              .pivot(columns, list(values))
              .agg(F.avg(_q(value))))


def interaction_curve(df: DataFrame, x_bin: str, hue: str, facet: str, value: str,
                      z: float = 1.959963984540054) -> DataFrame:
    """AG-11: 3-way means with a normal confidence interval of the mean:
    ``x_bin, hue, facet, mean, n, std, ci_lo, ci_hi``."""
    keys = [x_bin, hue, facet]
    g = (df.where(_not_null(keys)).groupBy(*[_q(k).alias(k) for k in keys])
           .agg(F.avg(_q(value)).alias("mean"), F.count(_q(value)).alias("n"),
                F.stddev_samp(_q(value)).alias("std")))
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return g.withColumns({"ci_lo": F.col("mean") - half, "ci_hi": F.col("mean") + half})
