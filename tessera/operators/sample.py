"""Order-dependent operators: ranks, batches, sampling, splits, top-k
(SL-*, SP-*, WN-*, SO-*).

A distributed table has no row order, so every operator here takes an
explicit key.  Global order is never computed by a ``Window`` without
``partitionBy`` over raw rows (that runs in one task).  Instead
:func:`prefix_sums` range-buckets the rows by approximate quantiles of the
order column, counts each bucket (a tiny table), turns those counts into
per-bucket offsets and finishes with a window *inside* each bucket — exact,
and parallel over buckets.

Sampling and splits use an arithmetic hash of the key that any SQL engine can
recompute (``mix64``), so results do not depend on partitioning and can be
checked against DuckDB; ``hash="xxhash"`` switches to Spark's xxhash64.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import boundaries as BO

DEFAULT_ROWS_PER_BUCKET = 1 << 20
# more buckets than this would make the boundary sketch and the offsets table
# large; beyond it buckets grow instead (a task sorts its bucket with spill)
MAX_BUCKETS = 50_000
BROADCAST_ROWS = 200_000
FINE_SKETCH = 256

# The odd multiplier of a published 32-bit integer mixer; below
# 2^31, so that products of 32-bit values stay inside a signed 64-bit integer
# (ANSI mode raises on overflow).
HASH_MULT = 73244475
MOD32 = 4294967296


def _q(c):
    return F.col(f"`{c}`") if isinstance(c, str) else c


def mixed_seed(seed: int) -> int:
    """The seed put through the mixer itself, so that keys and seeds do not
    cancel.  Shared with the SQL twin, which gets it as a literal."""
    h = (seed ^ 0x5BD1E995) % MOD32
    for _ in range(2):
        h = ((h ^ (h >> 16)) * HASH_MULT) % MOD32
    return h ^ (h >> 16)


def mix64(key, seed: int = 42) -> Column:
    """Deterministic 32-bit hash of an integer key, the same in any SQL engine:
    the key's halves and the mixed seed are xored, then xor-shifts alternate
    with multiplications (either alone is linear in the key)."""
    k = _q(key).cast("long")
    h = F.pmod(k, F.lit(MOD32)).bitwiseXOR(F.shiftrightunsigned(k, 32)).bitwiseXOR(F.lit(mixed_seed(seed)).cast("long"))
    for _ in range(2):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(HASH_MULT).cast("long"), F.lit(MOD32))
    return h.bitwiseXOR(F.shiftright(h, 16))


def key_hash(key, seed: int = 42, hash: str = "arith") -> Column:
    if hash == "xxhash":
        return F.xxhash64(_q(key), F.lit(seed))
    return mix64(key, seed)


# ------------------------------------------------------------- partitions --

def spread(df: DataFrame, n: int, *cols, rows: int = 1 << 20) -> DataFrame:
    """``df`` (about ``n`` rows) dealt out by ``cols``: to the session's number of
    partitions, or to more where these would get over ``rows`` rows each."""
    parts = math.ceil(n / rows)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *cols) if parts > usual else df.repartition(*cols)


def evenly(df: DataFrame, key: str, n: int, rows: int = 1 << 18, least: int = 1 << 16) -> DataFrame:
    """``df`` (``n`` rows) in about equal partitions for work that goes over it many
    times: one per core, or more with ``rows`` rows each.  A join or a scan leaves
    hundreds of tiny partitions, whose start costs more than their rows, or fewer than
    cores.  Up to ``least`` rows stay as they are."""
    if n <= least:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / rows)), _q(key))


# ------------------------------------------------------------- prefix sums --

def prefix_sums(df: DataFrame, order_cols: Sequence, values: dict[str, Column],
                partition_cols: Sequence[str] = (), exclusive: bool = True,
                rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                n_rows: int | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Add one column per ``values`` entry holding the sum of that value over
    the rows that come before (``exclusive``) or up to (inclusive) each row in
    ``order_cols`` order, within ``partition_cols``.  ``totals`` maps a value
    name to a column that receives its total over the whole partition.

    ``order_cols`` must define a total order (end it with a unique key); its
    first column must be numeric.  Plan (input passes: count + boundary
    sketch, bucket totals, final):

    1. ``B = min(ceil(N / rows_per_bucket), MAX_BUCKETS)`` range buckets from
       approximate quantiles of the first order column (B-1 numbers on the
       driver);
    2. bucket id by binary search (``Bucketizer``, JVM side);
    3. totals per (partition, bucket) — groups x B rows, collected when that
       is below ``BROADCAST_ROWS`` — turned into exclusive offsets and
       partition totals, then broadcast back (above the bound: a window over
       the totals table and a shuffle join);
    4. a running window *within* each (partition, bucket).
    """
    order_cols = [(_q(c)) for c in order_cols]
    vnames = list(values)
    totals = dict(totals or {})
    tmp = {f"_pv{i}": values[v] for i, v in enumerate(vnames)}
    d = df.withColumns(tmp)
    fine = None
    if n_rows is None:
        # count and a fine boundary sketch in ONE pass (bucket bounds only
        # need to be roughly balanced; any monotone bucketing is exact)
        r = d.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
            _q(order_cols[0]).cast("double"), [i / FINE_SKETCH for i in range(1, FINE_SKETCH)], 10_000).alias("q")).first()
        n_rows, fine = r["n"], r["q"] or []
    B = min(MAX_BUCKETS, max(1, math.ceil(n_rows / rows_per_bucket)))
    pcols = [_q(c) for c in partition_cols]
    frame_end = -1 if exclusive else 0
    if B <= 1 and not totals:
        w = (Window.partitionBy(*pcols) if pcols else Window.partitionBy()).orderBy(*order_cols) \
            .rowsBetween(Window.unboundedPreceding, frame_end)
        out = d.withColumns({v: F.coalesce(F.sum(f"_pv{i}").over(w), F.lit(0)) for i, v in enumerate(vnames)})
        return out.drop(*tmp)
    if B > 1:
        first = order_cols[0]
        if fine is not None and B <= FINE_SKETCH:
            bounds = [fine[min(len(fine) - 1, max(0, round(i * FINE_SKETCH / B) - 1))] for i in range(1, B)] \
                if fine else []
        else:
            probs = [i / B for i in range(1, B)]
            bounds = d.agg(F.percentile_approx(first.cast("double"), probs,
                                               max(10_000, 4 * B)).alias("b")).first()["b"] or []
        splits = [-math.inf] + sorted(set(float(b) for b in bounds)) + [math.inf]
        d = d.withColumn("_pk", first.cast("double"))
        d = Bucketizer(splits=splits, inputCol="_pk", outputCol="_bkt", handleInvalid="keep").transform(d)
        # nulls come first, as in the windows
        d = d.withColumn("_bkt", F.when(F.col("_pk").isNull(), -1).otherwise(F.col("_bkt").cast("int"))).drop("_pk")
    else:
        d = d.withColumn("_bkt", F.lit(0))
    keys = list(partition_cols) + ["_bkt"]
    tot = d.groupBy(*[_q(k) for k in keys]).agg(*[F.sum(f"_pv{i}").alias(f"_pt{i}") for i in range(len(vnames))])
    tot_rows = tot.limit(BROADCAST_ROWS + 1).collect()
    tcols = {f"_tt{vnames.index(v)}": name for v, name in totals.items()}
    if len(tot_rows) <= BROADCAST_ROWS:
        # offsets on the driver: the table has groups x B rows.  Walk each
        # partition's buckets in order; the running sum before a bucket is its
        # offset, the final sum is the partition total.
        npc = len(partition_cols)
        offsets, running = [], {}
        for r in sorted(tot_rows, key=lambda r: (tuple((x is None, x) for x in r[:npc]), r["_bkt"])):
            pk = tuple(r[:npc])
            before = running.get(pk, [0] * len(vnames))
            offsets.append((pk, r["_bkt"], before))
            running[pk] = [before[i] + (r[f"_pt{i}"] or 0) for i in range(len(vnames))]
        rows = [(*pk, b, *before, *[running[pk][vnames.index(v)] for v in totals])
                for pk, b, before in offsets]
        schema = [f for f in tot.schema.fields if f.name in keys]
        from pyspark.sql.types import StructField, StructType
        vtypes = {f"_pt{i}": tot.schema[f"_pt{i}"].dataType for i in range(len(vnames))}
        fields = [StructField(f.name, f.dataType, True) for f in schema] + \
            [StructField(f"_po{i}", vtypes[f"_pt{i}"], True) for i in range(len(vnames))] + \
            [StructField(f"_tt{vnames.index(v)}", vtypes[f"_pt{vnames.index(v)}"], True) for v in totals]
        offs = df.sparkSession.createDataFrame(rows, StructType(fields))
        side = F.broadcast(offs)
    else:
        wt = (Window.partitionBy(*pcols) if pcols else Window.partitionBy()).orderBy("_bkt")
        offs = tot.select(*[_q(k) for k in keys],
                          *[F.coalesce(F.sum(f"_pt{i}").over(wt.rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0)).alias(f"_po{i}") for i in range(len(vnames))],
                          *[F.sum(f"_pt{vnames.index(v)}").over(
                              Window.partitionBy(*pcols) if pcols else Window.partitionBy())
                            .alias(f"_tt{vnames.index(v)}") for v in totals])
        side = offs
    # the offsets side may derive from the same scan: join on renamed keys
    side = side.select(*[F.col(f"`{c}`").alias(f"_o_{c}") if c in keys else F.col(c) for c in side.columns])
    j = d.join(side, on=[_q(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys], how="inner") \
        .drop(*[f"_o_{k}" for k in keys])
    wi = Window.partitionBy(*[_q(k) for k in keys]).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, frame_end)
    out = j.withColumns({v: F.col(f"_po{i}") + F.coalesce(F.sum(f"_pv{i}").over(wi), F.lit(0))
                         for i, v in enumerate(vnames)})
    out = out.withColumnsRenamed(tcols) if tcols else out
    return out.drop(*tmp, *[f"_po{i}" for i in range(len(vnames))], "_bkt")


def range_rank(df: DataFrame, cols: Sequence, name: str = "_rank", rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
               n_rows: int | None = None) -> DataFrame:
    """0-based rank of every row in the order of ``cols`` (columns of any orderable
    type that together tell all rows apart), without a single-task window.

    Up to ``rows_per_bucket`` rows one window (bounded).  Beyond that the rows are
    range-partitioned and sorted on all of ``cols``, so equal first columns do not
    share a partition, and written down with their place in the partition; the
    counts per partition (one row each) become offsets, broadcast back."""
    cols = [_q(c) for c in cols]
    n = df.count() if n_rows is None else n_rows
    parts = min(MAX_BUCKETS, max(1, math.ceil(n / rows_per_bucket)))
    if parts <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*cols)) - 1)
    from tessera.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, "range-rank")
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the partition in the lower 33
    df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_at", at).write.parquet(path)
    d = spark.read.parquet(path)
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    run, offsets = 0, []
    for r in d.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        offsets.append((r["p"], run))
        run += r["n"]
    side = spark.createDataFrame(offsets, "_p int, _before long")
    return d.join(F.broadcast(side), part == F.col("_p")).withColumn(name, F.col("_before") + place).drop("_at", "_p", "_before")


def _bucket_tree(col: Column, bounds: list, lo: int, hi: int) -> Column:
    """Bucket number of ``col`` among sorted ``bounds`` as a balanced tree
    of comparisons (O(log B) per row, any orderable type): bucket i holds
    values in [bounds[i-1], bounds[i])."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col < F.lit(bounds[mid]), _bucket_tree(col, bounds, lo, mid)) \
            .otherwise(_bucket_tree(col, bounds, mid + 1, hi))


def string_rank(df: DataFrame, col: str, name: str = "_rank", rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                n_rows: int | None = None, sample_per_bucket: int = 64) -> DataFrame:
    """0-based rank of every row by a (non-numeric) column with DISTINCT
    values, without a single-task window: up to ``rows_per_bucket`` rows one
    window (bounded); beyond that, range buckets from a bounded sample
    (about ``sample_per_bucket`` values per bucket reach the driver), bucket
    ids by a comparison tree, per-bucket counts turned into offsets on the
    driver, and a window inside each bucket."""
    c = _q(col)
    n = df.count() if n_rows is None else n_rows
    B = min(MAX_BUCKETS, max(1, math.ceil(n / rows_per_bucket)))
    if B <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(c)) - 1)
    frac = min(1.0, B * sample_per_bucket / max(1, n))
    sample = sorted(r[0] for r in df.select(c).where(c.isNotNull()).sample(False, frac, 7).collect())
    bounds = sorted(set(sample[i * len(sample) // B] for i in range(1, B))) if sample else []
    d = df.withColumn("_sb", _bucket_tree(c, bounds, 0, len(bounds)))
    counts = {r["_sb"]: r["n"] for r in d.groupBy("_sb").agg(F.count(F.lit(1)).alias("n")).collect()}
    offs, run = {}, 0
    for b in sorted(counts):
        offs[b] = run
        run += counts[b]
    m = F.create_map(*[x for b, o in offs.items() for x in (F.lit(b), F.lit(o))])
    w = Window.partitionBy("_sb").orderBy(c)
    return d.withColumn(name, F.element_at(m, F.col("_sb")) + F.row_number().over(w) - 1).drop("_sb")


def ordered_index(df: DataFrame, order_cols: Sequence, partition_cols: Sequence[str] = (),
                  name: str = "_idx", **kw) -> DataFrame:
    """0-based position of every row in ``order_cols`` order (within
    ``partition_cols``) — an exact, parallel ``row_number() - 1``."""
    return prefix_sums(df, order_cols, {name: F.lit(1).cast("long")}, partition_cols,
                       exclusive=True, **kw)


# ------------------------------------------------------------- SL: top/head --

def top_k(df: DataFrame, k: int, by: str, key: str, ascending: bool = False) -> DataFrame:
    """SL-1: k rows with the largest (or smallest) ``by``; ties broken by
    ``key`` ascending; nulls never selected.  Plans as TakeOrderedAndProject
    (each task keeps k rows; the final merge holds k x tasks rows)."""
    o = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.where(_q(by).isNotNull()).orderBy(o, F.asc(key)).limit(k)


def sort_by(df: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """SL-2 (small result tables: weights, importances, correlations)."""
    return df.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by))


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """SL-3: first ``n`` rows in key order."""
    return df.orderBy(F.asc(key)).limit(n)


# ---------------------------------------------------------------- SP: sample --

def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, hash: str = "arith") -> DataFrame:
    """SP-1: exactly ``n`` rows without replacement: the n smallest hash
    values (ties by key).  Deterministic and independent of partitioning,
    unlike ``sample``/``rand``.  Top-n plan: no full sort."""
    h = key_hash(key, seed, hash)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2,
                     seed: int = 42, hash: str = "arith", exact: bool = True, group: str | None = None) -> DataFrame:
    """SP-2: adds ``is_test`` (boolean).

    ``key`` must be unique; where a cut meets a key that repeats or is null,
    ``boundaries.RepeatedKey`` is raised.  With ``group`` (an integer column, such
    as a patient's id) all rows of a group go to one side and nulls are one group:
    the groups are taken in hash order until the share of all rows is reached as
    nearly as whole groups allow, and each class's share is approached by chance.

    ``exact=True``: of each class the ``ceil(n_c * test_size)`` rows with the
    smallest hashes go to test, so every class has exactly that share.  Only
    the hash at the cut is searched (:mod:`~tessera.operators.boundaries`); no
    row is sorted or moved.  ``exact=False``: ``hash mod 10000 <
    test_size*10000``, binomial share."""
    h = key_hash(group or key, seed, hash)
    if not exact:
        h = F.coalesce(h, F.lit(0)) if group else h
        return df.withColumn("is_test", F.pmod(h, F.lit(10000)) < int(round(test_size * 10000)))
    by, tie = (None, _q(group)) if group else (label, _q(key))
    found = BO.find(df, h, lambda n: [math.ceil(round(n * test_size, 9))], by, tie, together=group is not None)
    return BO.segment(df, h, found, by, tie, "_s").withColumn("is_test", F.col("_s") == 0).drop("_s")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     hash: str = "arith", group: str | None = None) -> DataFrame:
    """SP-3: adds ``fold`` in 0..k-1 (``key`` and ``group`` as in
    :func:`stratified_split`).  Within each class the hash order is cut
    into k runs whose sizes differ by at most one row (``fold = floor(rank * k /
    n)``), the StratifiedKFold guarantee; only the k - 1 hashes at the cuts are
    searched."""
    h = key_hash(group or key, seed, hash)
    by, tie = (None, _q(group)) if group else (label, _q(key))
    found = BO.find(df, h, lambda n: [-(-j * n // k) for j in range(1, k)], by, tie, together=group is not None)
    return BO.segment(df, h, found, by, tie, "fold")


# ---------------------------------------------------------------- WN: batches --

def assign_batches(df: DataFrame, n_batches: int, key: str, remainder: str = "keep",
                   rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """WN-2: contiguous batches of ``floor(N / n)`` rows in key order, numbered
    1..n.  ``remainder`` says what becomes of the last ``N mod n`` rows: "keep"
    adds them to the last batch, "drop" leaves them out.  With fewer rows than
    batches every row is a batch ("keep") or none is ("drop").  Integer keys are
    cut at their exact boundaries without a sort; other keys are ranked."""
    if remainder not in ("keep", "drop"):
        raise ValueError("remainder must be 'keep' or 'drop'")
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        cuts = lambda n: [j * max(1, n // n_batches) for j in range(1, n_batches + 1)]
        found = BO.find(df, _q(key), cuts)
        n = next((m for m, _ in found.values()), 0)
        d = BO.segment(df, _q(key), found, name="batch").withColumn("batch", F.col("batch") + 1)
    else:
        n = df.count()
        d = ordered_index(df, [key], name="_i", rows_per_bucket=rows_per_bucket, n_rows=n)
        d = d.withColumn("batch", (F.floor(F.col("_i") / max(1, n // n_batches)) + 1).cast("int")).drop("_i")
    if remainder == "drop":
        return d.where(F.col("batch") <= (n_batches if n >= n_batches else 0))
    return d.withColumn("batch", F.least("batch", F.lit(n_batches)))


def rolling_mean(df: DataFrame, cols: Sequence[str], order: str, window: int,
                 partition_cols: Sequence[str] = (), suffix: str = "_ma") -> DataFrame:
    """WN-1: trailing moving average over the last ``window`` rows (fewer at
    the start, ``min_periods=1``).  Meant for per-batch metric tables; with
    ``partition_cols`` it runs per series."""
    w = (Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()) \
        .orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumns({f"{c}{suffix}": F.avg(_q(c)).over(w) for c in cols})


def rank_models(results: DataFrame, metric: str, name: str = "model") -> DataFrame:
    """WN-3: ranking table, best first (ties by name)."""
    w = Window.orderBy(F.desc_nulls_last(metric), F.asc(name))
    return results.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------------------ SO: sets --

def union_all(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """SO-1: union by column name; the first frame's column order rules."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def schema_diff(expected: Sequence[str], actual: Sequence[str]) -> dict:
    """SO-2: missing = expected - actual, unexpected = actual - expected."""
    e, a = set(expected), set(actual)
    return {"missing": sorted(e - a), "unexpected": sorted(a - e)}
