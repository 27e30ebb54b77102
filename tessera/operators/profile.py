"""Profiling aggregates (AG-1..8, AG-12, AG-17).

Every statistic over many columns is built as ONE aggregate (one scan with
partial aggregation before the shuffle) and then unpivoted with ``inline``
into a long result whose size is the number of columns.  Conventions follow
the reference (sample std, linear-interpolated quantiles, bias-corrected
skewness G1, pairwise-complete correlation).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import select_by_type
from tessera.operators.gram import correlation_cells


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def unpivot_struct_agg(agg_row_df: DataFrame, n: int, fields: Sequence[str],
                       names: Sequence[str], name_col: str = "feature") -> DataFrame:
    """Turn a one-row aggregate with columns ``{i}__{field}`` into one row per
    ``names[i]`` with the given fields (no job of its own)."""
    structs = [F.struct(F.lit(names[i]).alias(name_col),
                        *[F.col(f"{i}__{f}").alias(f) for f in fields])
               for i in range(n)]
    return agg_row_df.select(F.inline(F.array(*structs)))


def g1_skewness(c: Column, n: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``) from Spark's
    population skewness g1: ``g1 * sqrt(n(n-1)) / (n-2)``; null for n < 3."""
    nd = n.cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(nd * (nd - 1)) / (nd - 2))


# ------------------------------------------------------------------- AG-1 --

def table_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AG-1: one row per column: ``position, column, n_missing, n_rows``."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(q(c).isNull()).alias(f"{i}__n_missing") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.col(f"{i}__n_missing").alias("n_missing"),
                        F.col("_rows").alias("n_rows")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*structs)))


# ------------------------------------------------------------------- AG-2 --

def describe(df: DataFrame, cols: Sequence[str] | None = None,
             percentiles: Sequence[float] = (0.25, 0.5, 0.75),
             approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """AG-2: ``feature, count, mean, std, min, p25, p50, p75, max, skewness``.

    Moments of all columns in one aggregate.  Quantiles are exact (linear
    interpolation) through :func:`tessera.operators.quantiles.exact_quantiles`
    — no task holds a whole column — and enter the result as literals
    (columns x percentiles numbers); ``approx=True`` computes them with
    ``percentile_approx`` inside the same aggregate instead."""
    from tessera.operators.quantiles import exact_quantiles
    cols = list(cols or select_by_type(df, "numeric"))
    pnames = [f"p{int(round(p * 100))}" for p in percentiles]
    qs = None if approx else exact_quantiles(df, cols, percentiles)
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        n = F.count(x)
        pct = (F.percentile_approx(x, list(percentiles), accuracy) if approx
               else F.array(*[F.lit(v).cast("double") for v in qs[c]]))
        aggs += [n.alias(f"{i}__count"), F.avg(x).alias(f"{i}__mean"),
                 F.stddev_samp(x).alias(f"{i}__std"), F.min(x).alias(f"{i}__min"),
                 pct.alias(f"{i}__pct"), F.max(x).alias(f"{i}__max"),
                 g1_skewness(x, n).alias(f"{i}__skewness")]
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("feature"), F.col(f"{i}__count").alias("count"),
                  F.col(f"{i}__mean").alias("mean"), F.col(f"{i}__std").alias("std"),
                  F.col(f"{i}__min").alias("min")]
        fields += [F.col(f"{i}__pct")[k].alias(pn) for k, pn in enumerate(pnames)]
        fields += [F.col(f"{i}__max").alias("max"), F.col(f"{i}__skewness").alias("skewness")]
        structs.append(F.struct(*fields))
    return row.select(F.inline(F.array(*structs)))


# ------------------------------------------------------------------- AG-3 --

def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """AG-3: ``value, count, share``.  ``share`` divides by the counted rows
    (nulls included when ``dropna=False``).  The total is one distributed
    sum — no single-partition
    window, so a high-cardinality column stays parallel."""
    c = q(col)
    base = df.where(c.isNotNull()) if dropna else df
    g = base.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count")).first()[0] or 0
    return g.withColumn("share", F.col("count") / F.lit(float(total)) if total else F.lit(None).cast("double"))


# ------------------------------------------------------------------- AG-4 --

def missing_loss(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AG-4: rows, rows with at least one null, rows remaining, loss percent."""
    cols = list(cols or df.columns)
    anynull = F.greatest(*[q(c).isNull().cast("int") for c in cols]) if len(cols) > 1 \
        else q(cols[0]).isNull().cast("int")
    r = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(anynull).alias("n_with_null"))
    return r.select("n_rows", F.coalesce("n_with_null", F.lit(0)).cast("long").alias("n_with_null"),
                    (F.col("n_rows") - F.coalesce("n_with_null", F.lit(0))).cast("long").alias("n_remaining"),
                    F.when(F.col("n_rows") > 0, F.coalesce("n_with_null", F.lit(0)) * 100.0 / F.col("n_rows"))
                     .alias("loss_pct"))


# ------------------------------------------------------------------- AG-5 --

def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """AG-5: equal-width bins between min and max (last bin closed):
    ``bin, lo, hi, count``.  Two passes: a min/max aggregate (2 numbers to the
    driver), then a grouped count with partial aggregation."""
    x = q(col).cast("double")
    mn, mx = df.agg(F.min(x), F.max(x)).first()
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    span = mx - mn
    if span > 0:
        b = F.least(F.floor((x - F.lit(mn)) * F.lit(float(bins)) / F.lit(span)),
                    F.lit(bins - 1)).cast("int")
    else:
        b = F.lit(0)
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = span / bins if span > 0 else 0.0
    return g.select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


# ------------------------------------------------------------------- AG-6 --

def box_stats(df: DataFrame, col: str, whisker: float = 1.5) -> DataFrame:
    """AG-6: quartiles, fences, whisker ends (most extreme values inside the
    fences) and the outlier count — two aggregate passes, 3 numbers between."""
    from tessera.operators.quantiles import exact_quantiles
    x = q(col).cast("double")
    q1, med, q3 = exact_quantiles(df, [col], [0.25, 0.5, 0.75])[col]
    if q1 is None:  # no value at all
        return df.sparkSession.createDataFrame(
            [(col, *[None] * 8, 0)], "feature string, q1 double, median double, q3 double, iqr double, lo_fence double, "
            "hi_fence double, whisker_lo double, whisker_hi double, n_outliers long")
    iqr = q3 - q1
    lo, hi = q1 - whisker * iqr, q3 + whisker * iqr
    inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
    return df.agg(
        F.lit(col).alias("feature"), F.lit(q1).alias("q1"), F.lit(med).alias("median"),
        F.lit(q3).alias("q3"), F.lit(iqr).alias("iqr"), F.lit(lo).alias("lo_fence"),
        F.lit(hi).alias("hi_fence"),
        F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count_if(x.isNotNull() & ~inside).alias("n_outliers"))


# ------------------------------------------------------------------- AG-7 --

#: Above this many columns, expressions per pair give way to block-wise products.
WIDE = 48


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AG-7: pairwise-complete Pearson for every ordered pair, long form
    ``col_a, col_b, corr`` — all pairs in ONE aggregate (each unordered pair
    computed once, mirrored in the projection).  Above ``WIDE`` columns the pairs
    are cells of block-wise products (``gram``), whose plan does not grow."""
    cols = list(cols or select_by_type(df, "numeric"))
    if len(cols) > WIDE:
        named = F.array(*[F.lit(c) for c in cols])
        return correlation_cells(df, cols).select(F.get(named, F.col("i")).alias("col_a"),
                                                  F.get(named, F.col("j")).alias("col_b"), "corr")
    aggs, idx = [], {}
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            idx[(i, j)] = f"c_{i}_{j}"
            aggs.append(F.corr(q(cols[i]).cast("double"), q(cols[j]).cast("double")).alias(f"c_{i}_{j}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                        F.col(idx[(min(i, j), max(i, j))]).alias("corr"))
               for i in range(len(cols)) for j in range(len(cols))]
    return row.select(F.inline(F.array(*structs)))


# ------------------------------------------------------------------- AG-8 --

def correlation_with(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """AG-8: ``feature, corr`` of every numeric column (target included, as
    pandas does) against ``target``, sorted descending."""
    cols = list(cols or select_by_type(df, "numeric"))
    if target not in cols:
        cols = cols + [target]
    t = q(target).cast("double")
    row = df.agg(*[F.corr(q(c).cast("double"), t).alias(f"{i}__corr") for i, c in enumerate(cols)])
    return unpivot_struct_agg(row, len(cols), ["corr"], cols).orderBy(F.desc_nulls_last("corr"))


# ------------------------------------------------------------------ AG-12 --

def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """AG-12: contingency counts in long form; rows with a null key are
    dropped (pandas ``crosstab``)."""
    return (df.where(q(a).isNotNull() & q(b).isNotNull())
              .groupBy(q(a).alias(a), q(b).alias(b)).agg(F.count(F.lit(1)).alias("count")))


# ------------------------------------------------------------------ AG-17 --

def class_weights(df: DataFrame, label: str) -> DataFrame:
    """AG-17: ``label, n, weight`` with the balanced rule n / (k * n_c)."""
    g = df.where(q(label).isNotNull()).groupBy(q(label).alias(label)).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight",
                      fixed: dict | None = None) -> DataFrame:
    """Add a per-row weight column: balanced weights (collected: one number per
    class) or a ``fixed`` {class: weight} map (e.g. positive weight 4)."""
    if fixed is None:
        fixed = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    m = F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.withColumn(weight_col, F.coalesce(F.try_element_at(m, q(label)), F.lit(1.0)))
