"""Exact linear-interpolated quantiles at scale (numpy ``linear`` / SQL
``quantile_cont``), globally or per group.

Spark's ``percentile`` is exact but merges a value->count map of every
distinct value into ONE final task per column (and per group) — a single
hot group or a high-cardinality column then has to fit in one task.

Global quantiles (:func:`exact_quantiles`) use histogram bisection: only
aggregates with bounded state, no shuffle of rows (see the function).

Per-group quantiles (:func:`quantiles_frame`), all distributed:

1. stack the columns into ``(by..., column, v)`` and collapse duplicates
   with a partial + final aggregate -> distinct values with counts;
2. rank the distinct values inside ``(by..., column)`` with
   :func:`tessera.operators.sample.prefix_sums` (range buckets, a window
   inside each bucket) -> rows strictly before each value;
3. build the tiny table of target ranks ``floor(p (n-1))`` and
   ``ceil(p (n-1))`` per group (size = groups x columns x probs x 2) and
   find the value holding each rank by an equi-join on the group keys plus a
   range condition (broadcast when that table is small);
4. interpolate ``lo + frac (hi - lo)`` per (group, column, p).
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sample import BROADCAST_ROWS, prefix_sums


# distinct values ranked per task: small buckets keep many windows in flight
QUANTILE_ROWS_PER_BUCKET = 1 << 17


def quantiles_frame(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    rows_per_bucket: int = QUANTILE_ROWS_PER_BUCKET, _cached: list | None = None) -> DataFrame:
    """``by..., column, k, p, value`` — the ``probs[k]`` quantile of every
    column (nulls ignored) per group.  The distinct-value table is persisted
    because four small jobs read it; pass a list as ``_cached`` to receive
    it for unpersisting."""
    by = list(by)
    stacked = df.select(*[F.col(f"`{b}`").alias(b) for b in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])))
    stacked = stacked.where(F.col("v").isNotNull())
    for b in by:
        stacked = stacked.where(F.col(b).isNotNull())
    keys = by + ["column"]
    dist = stacked.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("cnt")).persist()
    dist = prefix_sums(dist, ["v"], {"before": F.col("cnt")}, partition_cols=keys, exclusive=True,
                       rows_per_bucket=rows_per_bucket).persist()
    if _cached is not None:
        _cached.append(dist)
    totals = dist.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    targets = totals.select(*keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("k", "p"))
    pos = F.col("p") * (F.col("n") - 1)
    targets = targets.select(*keys, "k", "p", F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"),
                             (pos - F.floor(pos)).alias("frac"))
    roles = targets.select(*keys, "k", "p", "frac", F.explode(F.array(
        F.struct(F.lit("lo").alias("role"), F.col("lo").alias("r")),
        F.struct(F.lit("hi").alias("role"), F.col("hi").alias("r")))).alias("t")) \
        .select(*keys, "k", "p", "frac", "t.role", "t.r")
    # both sides derive from the same scan: rename the target keys
    roles = roles.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "k", "p", "frac", "role", "r")
    side = F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles
    cond = [F.col(k) == F.col(f"_t_{k}") for k in keys] + [
        F.col("before") <= F.col("r"), F.col("r") < F.col("before") + F.col("cnt")]
    hit = dist.join(side, cond, "inner").select(*keys, "k", "p", "frac", "role", "v")
    g = hit.groupBy(*keys, "k", "p", "frac").agg(
        F.max(F.when(F.col("role") == "lo", F.col("v"))).alias("vlo"),
        F.max(F.when(F.col("role") == "hi", F.col("v"))).alias("vhi"))
    return g.select(*keys, "k", "p", (F.col("vlo") + F.col("frac") * (F.col("vhi") - F.col("vlo"))).alias("value"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    bins: int = 1024, collect_limit: int = 4096) -> dict[str, list]:
    """Global quantiles as ``{column: [q(p) for p in probs]}`` (None for an
    all-null column), exact with linear interpolation, by histogram
    bisection — only aggregates, no shuffle of rows:

    1. one aggregate: count, min, max of every column;
    2. per open interval, ``bins`` equal-width bins counted with min / max
       per bin (a grouped count with partial aggregation; at most
       intervals x bins groups).  Bin numbers are monotone in x, so the bin
       holding a target rank is the contiguous value range [bin min, bin max];
    3. once that range holds at most ``collect_limit`` values they are
       collected sorted (bounded) and the rank is read off; larger ranges
       are bisected again.  A range of equal values resolves at once.

    Every pass scans the columns; state is bounded by ``intervals x bins``
    and ``collect_limit`` whatever the table size, and the result does not
    depend on either.  NaN counts as missing; infinities rank at the ends and
    are counted, not bisected."""
    cols = list(cols)
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    x = {c: F.when(~F.isnan(v), v) for c, v in x.items()}
    base = df.select(*[x[c].alias(f"_x{i}") for i, c in enumerate(cols)])
    inf = float("inf")

    def finite(i):
        return F.when((F.col(f"_x{i}") > F.lit(-inf)) & (F.col(f"_x{i}") < F.lit(inf)), F.col(f"_x{i}"))
    row = base.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"_x{i}").alias(f"n{i}"), F.count_if(F.col(f"_x{i}") == F.lit(-inf)).alias(f"ninf{i}"),
        F.count(finite(i)).alias(f"fin{i}"), F.min(finite(i)).alias(f"lo{i}"), F.max(finite(i)).alias(f"hi{i}"))]).first()
    # pending ranks: (col index, rank) -> [a, b, below, value, count]
    # (below = #values < a, count = #values in [a, b])
    need: dict[tuple[int, int], list] = {}
    plan: dict[int, list] = {}
    for i in range(len(cols)):
        n = row[f"n{i}"]
        if not n:
            continue
        plan[i] = []
        for p in probs:
            pos = p * (n - 1)
            lo_r, hi_r = math.floor(pos), math.ceil(pos)
            plan[i].append((lo_r, hi_r, pos - lo_r))
            for r in (lo_r, hi_r):
                below, fin = row[f"ninf{i}"], row[f"fin{i}"]
                if r < below or r >= below + fin:
                    need[(i, r)] = [None, None, 0, -inf if r < below else inf, n]
                else:
                    need[(i, r)] = [row[f"lo{i}"], row[f"hi{i}"], below, None, fin]

    def in_range(i, a, b):
        xi = F.col(f"_x{i}")
        return (xi >= F.lit(a)) & (xi <= F.lit(b))

    while True:  # the range between the smallest and largest value of a bin shrinks every time
        for v in need.values():
            if v[3] is None and v[0] == v[1]:
                v[3] = v[0]
        open_ = {k: v for k, v in need.items() if v[3] is None}
        if not open_:
            break
        # ranges small enough: collect them sorted (bounded) in one aggregate
        take = sorted({(i, v[0], v[1]) for (i, _), v in open_.items() if v[4] <= collect_limit})
        if take:
            got = base.agg(*[F.array_sort(F.collect_list(F.when(in_range(i, a, b), F.col(f"_x{i}")))).alias(f"v{j}")
                             for j, (i, a, b) in enumerate(take)]).first()
            vals = {key: got[f"v{j}"] for j, key in enumerate(take)}
            for (i, r), v in open_.items():
                key = (i, v[0], v[1])
                if key in vals:
                    v[3] = vals[key][r - v[2]]
        open_ = {k: v for k, v in open_.items() if v[3] is None}
        if not open_:
            break
        # larger ranges: one grouped count over `bins` equal-width bins each
        intervals = sorted({(i, v[0], v[1]) for (i, _), v in open_.items()})
        ids = {iv: j for j, iv in enumerate(intervals)}
        # ONE scan for all open intervals: each row yields (interval, bin, x)
        # for the intervals it falls in (explode + null drop stay in codegen)
        entries = []
        for j, (i, a, b) in enumerate(intervals):
            xi = F.col(f"_x{i}")
            # halves, so that the width of the range cannot overflow
            share = (xi / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2)
            bn = F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
            entries.append(F.when(in_range(i, a, b), F.struct(F.lit(j).alias("j"), bn.alias("k"), xi.alias("v"))))
        ex = base.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull())
        hist = ex.groupBy("e.j", "e.k").agg(F.count(F.lit(1)).alias("c"), F.min("e.v").alias("mn"),
                                            F.max("e.v").alias("mx")).collect()
        by_j: dict[int, list] = {}
        for h in hist:
            by_j.setdefault(h["j"], []).append((h["k"], h["c"], h["mn"], h["mx"]))
        for (i, r), v in open_.items():
            cum = v[2]
            for k, c, mn, mx in sorted(by_j.get(ids[(i, v[0], v[1])], [])):
                if r < cum + c:
                    v[0], v[1], v[2], v[4] = mn, mx, cum, c
                    break
                cum += c
    out = {}
    for i, c in enumerate(cols):
        if i not in plan:
            out[c] = [None] * len(probs)
            continue
        res = []
        for lo_r, hi_r, frac in plan[i]:
            vlo, vhi = need[(i, lo_r)][3], need[(i, hi_r)][3]
            res.append(vlo if vlo == vhi or not frac else vlo + frac * (vhi - vlo))
        out[c] = res
    return out
