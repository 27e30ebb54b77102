"""Imputation and scaling (IS-1..7) as fit (one aggregate, result size =
number of columns or groups) + transform (a narrow projection with literals
or a join with a small statistics table)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_GROUPS = 200_000


def _q(c):
    return F.col(f"`{c}`")


def _fill_type(df: DataFrame, c: str):
    """Type of a median-filled column: integral columns become double (a
    median may fall between two integers; pandas turns such a column into
    float as well), other numeric types keep theirs."""
    from pyspark.sql.types import DoubleType, IntegralType
    t = df.schema[c].dataType
    return DoubleType() if isinstance(t, IntegralType) else t


def impute_constant(df: DataFrame, cols: Sequence[str], value, blank_as_null: bool = False) -> DataFrame:
    """IS-1: fill nulls (and ``""`` when ``blank_as_null``) with a constant."""
    out = {}
    for c in cols:
        if c not in df.columns:
            continue
        x = _q(c)
        miss = x.isNull() | (x == F.lit("")) if blank_as_null else x.isNull()
        out[c] = F.when(miss, F.lit(value)).otherwise(x)
    return df.withColumns(out) if out else df


def fit_medians(df: DataFrame, cols: Sequence[str], approx: bool = False,
                accuracy: int = 10_000) -> dict[str, float]:
    """Median of every column in one aggregate (exact linear interpolation, or
    ``percentile_approx`` for high-cardinality columns at scale)."""
    if not approx:
        from tessera.operators.quantiles import exact_quantiles
        return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
    aggs = [F.percentile_approx(_q(c).cast("double"), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def impute_median(df: DataFrame, cols: Sequence[str], approx: bool = False,
                  medians: dict | None = None) -> DataFrame:
    """IS-2: fill nulls with the column median (fit on ``df`` unless
    ``medians`` from a training table is given)."""
    cols = [c for c in cols if c in df.columns]
    medians = medians if medians is not None else fit_medians(df, cols, approx)
    return df.withColumns({c: F.coalesce(_q(c).cast(_fill_type(df, c)), F.lit(medians[c]).cast(_fill_type(df, c)))
                           for c in cols if medians.get(c) is not None})


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column, the smallest on ties (sklearn).

    Columns of one type are stacked as (column, value) rows and counted in one
    scan; the most frequent value of each column is an aggregate over the counts
    (one row per task and column at the end), so no task holds the distinct values
    of a column."""
    by_type: dict = {}
    for i, c in enumerate(cols):
        by_type.setdefault(df.schema[c].dataType, []).append((i, c))
    out: dict = dict.fromkeys(cols)
    for group in by_type.values():
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _q(c).alias("v")) for i, c in group])).alias("x")) \
            .select("x.i", "x.v").where("v IS NOT NULL")
        counts = stacked.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        # the largest count, then the smallest value: min over (-n, v)
        best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v")).collect()
        out.update({cols[r["i"]]: r["v"] for r in best})
    return out


def impute_mode(df: DataFrame, cols: Sequence[str], modes: dict | None = None) -> DataFrame:
    """IS-3."""
    cols = [c for c in cols if c in df.columns]
    modes = modes if modes is not None else fit_modes(df, cols)
    return df.withColumns({c: F.coalesce(_q(c), F.lit(modes[c])) for c in cols if modes.get(c) is not None})


def group_medians(df: DataFrame, group: str, target: str, approx: bool = False,
                  accuracy: int = 10_000) -> DataFrame:
    """Median of ``target`` per non-null ``group`` value: ``_g, _gm``.

    Exact medians come from the bucketed quantile plan partitioned by group,
    so a group holding a third of the rows is still spread over many tasks
    (``percentile`` would merge its whole value map in one task)."""
    if approx:
        t = _q(target).cast("double")
        return df.where(_q(group).isNotNull()).groupBy(_q(group).alias("_g")).agg(
            F.percentile_approx(t, 0.5, accuracy).alias("_gm"))
    from tessera.operators.quantiles import quantiles_frame
    d = df.select(_q(group).alias("_g"), _q(target).alias("_t"))
    return quantiles_frame(d, ["_t"], [0.5], by=["_g"]).select("_g", F.col("value").alias("_gm"))


def impute_group_median(df: DataFrame, group: str, target: str, approx: bool = False,
                        stats: DataFrame | None = None) -> DataFrame:
    """IS-4: fill nulls of ``target`` with the median of the row's group;
    unseen or null groups stay null.  The statistics table has one row per
    group; it is broadcast only below ``BROADCAST_GROUPS`` rows (checked)."""
    stats = stats if stats is not None else group_medians(df, group, target, approx)
    side = F.broadcast(stats) if stats.count() <= BROADCAST_GROUPS else stats
    j = df.join(side, _q(group) == F.col("_g"), "left")
    t = _fill_type(df, target)
    return j.withColumn(target, F.coalesce(_q(target).cast(t), F.col("_gm").cast(t))).drop("_g", "_gm")


def fit_standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> dict[str, tuple]:
    """(mean, std) of every present column in one aggregate; ``ddof=1``
    sample std (reference scaler), ``ddof=0`` population (sklearn)."""
    cols = [c for c in cols if c in df.columns]
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(_q(c)).alias(f"m{i}"), sd(_q(c)).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1, eps: float = 1e-9,
                stats: dict | None = None) -> DataFrame:
    """IS-5 / IS-6: ``(x - mean) / (std + eps)`` on present columns
    (``eps=0`` and ``ddof=0`` reproduce sklearn's StandardScaler, where a
    zero std leaves the column centred only)."""
    stats = stats if stats is not None else fit_standardize(df, cols, ddof)
    out = {}
    for c, (mu, sd) in stats.items():
        if mu is None:
            continue
        sd = sd if sd is not None else 0.0
        denom = sd + eps if (sd + eps) != 0 else 1.0
        out[c] = (_q(c) - F.lit(mu)) / F.lit(denom)
    return df.withColumns(out) if out else df


def fit_robust(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """Quartiles of every column (exact, bucketed at scale)."""
    from tessera.operators.quantiles import exact_quantiles
    return {c: tuple(v) for c, v in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items()}


def robust_scale(df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> DataFrame:
    """IS-7: ``(x - median) / IQR`` (centred, as sklearn's RobustScaler);
    an IQR of 0 divides by 1."""
    cols = [c for c in cols if c in df.columns]
    stats = stats if stats is not None else fit_robust(df, cols)
    out = {}
    for c in cols:
        q1, med, q3 = stats[c]
        if med is None:
            continue
        iqr = (q3 - q1) or 1.0
        out[c] = (_q(c) - F.lit(med)) / F.lit(iqr)
    return df.withColumns(out) if out else df
