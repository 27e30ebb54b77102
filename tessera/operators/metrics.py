"""Classification metrics as aggregates (MT-1..7).

Counts-based metrics are one conditional aggregate (optionally per group).
ROC-AUC is the exact rank statistic with ties counted one half:

    AUC = sum_s pos(s) * (neg(< s) + neg(s)/2) / (P * N)

computed on the table grouped by score (distinct scores) inside range buckets of
the scores, so no single task ever scans all scores; a bucket's sums and those of
the buckets below it give the group's.  As in the
reference, AUC is 0.5 when it is undefined (one class only).
"""

from __future__ import annotations

import math
from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import sample as SA
from tessera.operators.sample import prefix_sums

#: Quantiles that the bucket bounds of scores are taken from.
SKETCH = 1024
#: Rows that a task sorts at once, scores of a task that bucket bounds are taken from, and
#: scores (of about 8 bytes) that go to one partition, where many scorers are evaluated.
CHUNK, MARKS, PART_SCORES = 1 << 17, 256, 1 << 22
METRICS = ["roc_auc", "f1", "precision", "recall", "accuracy"]


def _q(c):
    return F.col(f"`{c}`") if isinstance(c, str) else c


def _div0(a: Column, b: Column) -> Column:
    """``a / b`` with 0 when ``b`` is 0 (sklearn ``zero_division=0``)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MT-1: ``tp, fp, tn, fn`` (and ``n``) per group, zero-filled."""
    y, p = _q(label), _q(pred)
    aggs = [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"),
            F.count(F.lit(1)).alias("n")]
    base = df.where(y.isNotNull() & p.isNotNull())
    return base.groupBy(*[_q(b).alias(b) for b in by]).agg(*aggs) if by else base.agg(*aggs)


def _rates(tp, fp, tn, fn) -> dict[str, Column]:
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    accuracy = _div0(tp + tn, tp + fp + tn + fn)
    return {"f1": f1, "precision": precision, "recall": recall, "accuracy": accuracy}


def _score_bounds(scores: DataFrame, rows_per_bucket: int, copies: int = 1) -> tuple[int, list[float], bool]:
    """(rows, bounds that cut the column ``_s`` into about equal buckets of ``rows_per_bucket``
    rows, whether some score stands in very many rows), from one pass; ``scores`` stands for
    ``copies`` times its rows."""
    r = scores.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "_s", [i / SKETCH for i in range(1, SKETCH)], 10_000).alias("q")).first()
    q = r["q"] or []
    n = r["n"] * copies
    buckets = min(SKETCH, max(1, math.ceil(n / rows_per_bucket)))
    at = {q[round(i * SKETCH / buckets) - 1] for i in range(1, buckets)} if q else set()
    return n, sorted(b for b in at if math.isfinite(b)), len(set(q)) < len(q)


def _listed() -> Column:
    return F.array_sort(F.collect_list(F.struct("_bkt", "u", "p", "n"))).alias("_c")


def _listed_auc() -> Column:
    """The AUC from a group's buckets ``_c``, put in order and added up."""
    start = F.struct(F.lit(0.0).alias("u"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    t = F.aggregate("_c", start, lambda t, c: F.struct(
        (t["u"] + c["u"] + c["p"] * t["n"].cast("double")).alias("u"), (t["p"] + c["p"]).alias("p"), (t["n"] + c["n"]).alias("n")))
    P, N = t["p"], t["n"]
    return F.when((P > 0) & (N > 0), t["u"] / (P.cast("double") * N.cast("double"))).otherwise(F.lit(0.5))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
            rows_per_bucket: int = 1 << 20, like: DataFrame | None = None, copies: int = 1) -> DataFrame:
    """MT-3: exact rank AUC (ties = 1/2) per group: ``by..., roc_auc``.

    The rows are moved once: to the bucket of their group and score, in which they
    are counted by score.  A group's few buckets then are put in order and added up.
    The bucket bounds come from the scores themselves, or from those of ``like`` (a
    table with the column ``score``, ``df`` having ``copies`` times its rows) where a
    pass over ``df`` is dear; any bounds give the same result.  Where some score stands in very many rows, rows are
    counted by score in every task before they move."""
    s, y = _q(score).cast("double"), _q(label)
    known = df.where(_q(score).isNotNull() & y.isNotNull()).select(*[_q(b).alias(b) for b in by], s.alias("_s"), y.alias("_y"))
    scores = known if like is None else like.where(_q(score).isNotNull()).select(s.alias("_s"))
    n, bounds, hot = _score_bounds(scores.select("_s"), rows_per_bucket, 1 if like is None else copies)
    counts = [F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg")]
    # NaN is above every bound, and Bucketizer's "keep" puts it into a last bucket of its own
    d = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="_s", outputCol="_bkt",
                   handleInvalid="keep").transform(known).withColumn("_bkt", F.col("_bkt").cast("int"))
    cell = [*[_q(b) for b in by], F.col("_bkt")]
    if hot:
        g = d.groupBy(*cell, "_s").agg(*counts).repartition(*cell)
    else:
        g = SA.spread(d, n, *cell).groupBy(*cell, "_s").agg(*counts)
    below = Window.partitionBy(*cell).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_nb", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    cells = g.groupBy(*cell).agg(F.sum(F.col("_pos") * (F.col("_nb") + F.col("_neg") / 2.0)).alias("u"),
                                 F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))
    r = cells.groupBy(*[_q(b) for b in by]).agg(_listed()) if by else cells.agg(_listed())
    return r.select(*[_q(b) for b in by], _listed_auc().alias("roc_auc"))


def score_summary(df: DataFrame, score: str, label: str, by: Sequence[str] = (), bins: int = 4096) -> DataFrame:
    """MT-3 for tables too large to sort: ``by..., bin, pos, neg``, counts of the
    labels in ``bins`` equal bins of the score over [0, 1], at most ``bins`` rows a
    group after one aggregate with partial counts in every task.  Scores below 0
    count in the first bin, those above 1 and NaN in the last.  Summaries of parts
    (days, batches, clusters) add up: see :func:`merge_summaries`."""
    s, y = _q(score).cast("double"), _q(label)
    place = F.when(F.isnan(s) | (s >= 1), bins - 1).when(s <= 0, 0).otherwise(F.floor(s * bins)).cast("int")
    # s * bins may round up to bins just below 1
    return (df.where(s.isNotNull() & y.isNotNull())
              .groupBy(*[_q(b).alias(b) for b in by], F.least(place, F.lit(bins - 1)).alias("bin"))
              .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def merge_summaries(summaries: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The summary of all rows from the summaries of disjoint parts (equal bins)."""
    one = summaries[0]
    for more in summaries[1:]:
        one = one.unionByName(more)
    return one.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def summary_auc(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., roc_auc, max_error`` of a score summary.  A positive and a negative
    of one bin count one half, whatever their order, and all other pairs count as in
    the exact statistic; so it is off by at most half the share of pairs that fall
    into one bin, which is ``max_error``.  The running sums see a group's bins, never
    its rows."""
    below = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    g = summary.withColumn("_nb", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pairs = F.col("_P").cast("double") * F.col("_N")
    aggs = [F.sum(F.col("pos") * (F.col("_nb") + F.col("neg") / 2.0)).alias("_u"),
            F.sum(F.col("pos").cast("double") * F.col("neg")).alias("_same"),
            F.sum("pos").alias("_P"), F.sum("neg").alias("_N")]
    r = g.groupBy(*by).agg(*aggs) if by else g.agg(*aggs)
    return r.select(*by, F.when(pairs > 0, F.col("_u") / pairs).otherwise(F.lit(0.5)).alias("roc_auc"),
                    F.when(pairs > 0, F.col("_same") / 2.0 / pairs).otherwise(F.lit(0.0)).alias("max_error"))


def binary_metrics(df: DataFrame, label: str, pred: str, prob: str | None = None,
                   by: Sequence[str] = (), rows_per_bucket: int = 1 << 20, bins: int | None = None) -> DataFrame:
    """MT-2: ``by..., n, roc_auc, f1, precision, recall, accuracy``.  The AUC is
    exact; with ``bins`` it is that of :func:`score_summary`."""
    c = confusion(df, label, pred, by)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.select(*by, "n", *[v.alias(k) for k, v in _rates(tp, fp, tn, fn).items()])
    if prob is None:
        return out.withColumn("roc_auc", F.lit(0.5)).select(*by, "n", *METRICS)
    known = df.where(_q(pred).isNotNull())
    auc = roc_auc(known, prob, label, by, rows_per_bucket) if bins is None \
        else summary_auc(score_summary(known, prob, label, by, bins), by).drop("max_error")
    if by:
        # both sides hold one row per group
        out = out.join(auc, on=list(by), how="left")
    else:
        out = out.withColumn("roc_auc", F.lit(auc.first()["roc_auc"]))
    return out.select(*by, "n", *METRICS)


def _chunks(batches: Iterator[pa.RecordBatch], slots: int, pred: bool) -> Iterator[tuple]:
    """(columns before the label, labels, scores, predictions or None) of some rows at a
    time.  Labels and predictions are NaN where missing, scores masked arrays."""
    def matrix(a: pa.Array) -> np.ma.MaskedArray:
        flat = a.flatten()
        if len(flat) != len(a) * slots:
            raise ValueError(f"every array must have {slots} elements")
        gone = None if flat.null_count == 0 else ~np.asarray(flat.is_valid())
        v = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, slots)
        return np.ma.array(v, mask=False if gone is None else gone.reshape(-1, slots))

    def chunk(t: pa.Table) -> tuple:
        t = t.combine_chunks()
        c = [x.chunk(0) for x in t.columns]
        tail = 3 if pred else 2
        y = c[-tail].cast(pa.float64()).to_numpy(zero_copy_only=False)
        return c[:-tail], y, matrix(c[1 - tail]), matrix(c[-1]) if pred else None
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= CHUNK:
            yield chunk(pa.Table.from_batches(held))
            held, rows = [], 0
    if held:
        yield chunk(pa.Table.from_batches(held))


def _groups(cols: Sequence[pa.Array], rows: int) -> Iterator[tuple[list, np.ndarray]]:
    """(values, row numbers) of every combination of ``cols``."""
    number = np.zeros(rows, dtype=np.int64)
    for c in cols:
        codes = c.dictionary_encode(null_encoding="encode")
        number = number * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False)
    for g in np.unique(number):
        at = np.flatnonzero(number == g)
        yield [c[int(at[0])].as_py() for c in cols], at


def _counted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(v, return_counts=True)


def _runs(slots: int, pred: bool, threshold: float, bounds: Sequence[Sequence[float]], schema: pa.Schema) -> Callable:
    """Per slot, group and bucket: sorted scores of the positives and the negatives of some
    rows, with their numbers if some are equal; the counts of the confusion come once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lead, y, s, p in _chunks(batches, slots, pred):
            out: list[list] = [[] for _ in schema]
            for values, at in _groups(lead, len(y)):
                yy = y[at]
                for k in range(slots):
                    x, known = s.data[at, k], ~np.ma.getmaskarray(s)[at, k]
                    if pred:
                        said, told = p.data[at, k], ~np.ma.getmaskarray(p)[at, k]
                    else:
                        said, told = (known & ((x >= threshold) | np.isnan(x))).astype(int), True
                    told = told & ~np.isnan(yy)
                    counts = [int((told & (yy == a) & (said == b)).sum()) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0))]
                    known &= told
                    counts += [int(told.sum()), int(known.sum())]
                    if not counts[4]:
                        continue
                    sides = []
                    for label in (1, 0):
                        v, n = _counted(x[known & (yy == label)])
                        cuts = np.searchsorted(v, bounds[k], "left") if bounds else []
                        sides.append([(a, b if len(b) and b.max() > 1 else b[:0]) for a, b in zip(np.split(v, cuts), np.split(n, cuts), strict=True)])
                    for b, ((pv, pn), (nv, nn)) in enumerate(zip(*sides, strict=True)):
                        if b and not (len(pv) or len(nv)):
                            continue
                        row = [k, *values, b, pv.tobytes(), pn.astype(np.int64).tobytes(), nv.tobytes(), nn.astype(np.int64).tobytes(),
                               *(counts if b == 0 else [0] * len(counts))]
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
    return run


def _merged(lead: int, schema: pa.Schema) -> Callable:
    """A slot's, group's and bucket's runs: pairs in order (ties one half), positives,
    negatives and added counts."""
    def numbers(t: pa.Table, values: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
        v = [np.frombuffer(m.as_buffer()) for m in t.column(values)]
        n = [np.frombuffer(m.as_buffer(), dtype=np.int64) for m in t.column(counts)]
        v, n = np.concatenate(v), np.concatenate([b if len(b) else np.ones(len(a), dtype=np.int64) for a, b in zip(v, n, strict=True)])
        order = np.argsort(v, kind="stable")  # merges sorted runs
        return v[order], n[order]

    def run(t: pa.Table) -> pa.Table:
        pv, pn = numbers(t, "pos", "pos_n")
        nv, nn = numbers(t, "neg", "neg_n")
        below = np.concatenate([[0], np.cumsum(nn)])
        left, right = below[np.searchsorted(nv, pv, "left")], below[np.searchsorted(nv, pv, "right")]
        u = float((pn * ((left + right) / 2.0)).sum())
        sums = [sum(t.column(c).to_pylist()) for c in schema.names[lead + 3:]]
        first = [t.column(c)[0].as_py() for c in schema.names[:lead]]
        return pa.table([pa.array([v], f.type) for v, f in zip([*first, u, int(pn.sum()), int(nn.sum()), *sums], schema, strict=True)], schema=schema)
    return run


def _marks(slots: int, pred: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s, _ in _chunks(batches, slots, pred):
            for k in range(slots):
                v = np.sort(s[:, k].compressed())
                v = v[np.isfinite(v)]
                v = v[(np.arange(MARKS) * len(v)) // MARKS] if len(v) else v
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, dtype=np.int32)), pa.array(v)], names=["slot", "s"])
    return run


def slot_metrics(df: DataFrame, label: str, scores: str, slots: int, preds: str | None = None, threshold: float = 0.5,
                 by: Sequence[str] = (), rows_per_bucket: int = 1 << 20, n: int | None = None) -> DataFrame:
    """MT-2 of many scorers of the same rows: ``slot, by..., n, roc_auc, f1, precision,
    recall, accuracy``, as :func:`binary_metrics` of every element (slot) of the arrays
    ``scores`` and ``preds`` (without these, scores from ``threshold`` on are positive).

    Rows are not copied per scorer.  A task sorts the scores of its rows under each scorer
    and sends the sorted values, cut at common bounds; a bucket's values are merged in one
    task and its pairs counted, and a group's few buckets are put in order and added up.
    Bounds are needed above ``rows_per_bucket`` rows; any give the same result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    pred = preds is not None
    d = df.select(*[_q(b).alias(b) for b in by], _q(label).cast("double").alias("_y"), _q(scores).cast("array<double>").alias("_s"),
                  *([_q(preds).cast("array<int>").alias("_p")] if pred else []))
    n = d.count() if n is None else n
    buckets = min(SKETCH, max(1, math.ceil(n / rows_per_bucket)))
    bounds: list = []
    if buckets > 1:
        marks = d.mapInArrow(_marks(slots, pred), "slot int, s double")
        found = marks.groupBy("slot").agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10_000).alias("q")).collect()
        found = {r["slot"]: sorted(set(r["q"])) for r in found}
        bounds = [found.get(k, []) for k in range(slots)]
    counts = ["tp", "fp", "tn", "fn", "rows", "scored"]
    head = StructType().add("slot", "integer")
    for b in by:
        head = head.add(b, d.schema[b].dataType)
    cell = ["slot", *by, "_bkt"]
    runs, cells = (StructType(list(head.fields)).add("_bkt", "integer") for _ in range(2))
    for c in ("pos", "pos_n", "neg", "neg_n"):
        runs = runs.add(c, "binary")
    cells = cells.add("u", "double").add("p", "long").add("n", "long")
    for c in counts:
        runs, cells = runs.add(c, "long"), cells.add(c, "long")
    g = d.mapInArrow(_runs(slots, pred, threshold, bounds, to_arrow_schema(runs)), runs)
    g = SA.spread(g, n * slots, *cell, rows=PART_SCORES).groupBy(*cell).applyInArrow(_merged(len(cell), to_arrow_schema(cells)), cells)
    r = g.groupBy(*cell[:-1]).agg(_listed(), *[F.sum(c).alias(c) for c in counts])
    rates = _rates(*[F.col(c) for c in counts[:4]])
    auc = F.when(F.col("scored") > 0, _listed_auc())
    return r.select(*cell[:-1], F.col("rows").alias("n"), auc.alias("roc_auc"), *[v.alias(k) for k, v in rates.items()]) \
        .select(*cell[:-1], "n", *METRICS)


def roc_curve(df: DataFrame, score: str, label: str, rows_per_bucket: int = 1 << 20) -> DataFrame:
    """MT-4: one point per distinct score threshold t (predict positive when
    ``score >= t``): ``threshold, tp, fp, tpr, fpr, precision, recall``."""
    s, y = _q(score), _q(label)
    g = (df.where(s.isNotNull() & y.isNotNull())
           .groupBy(s.cast("double").alias("threshold"))
           .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")))
    P, N = df.where(s.isNotNull() & y.isNotNull()).agg(
        F.count_if(y == 1), F.count_if(y == 0)).first()
    g = prefix_sums(g.withColumn("_o", -F.col("threshold")), ["_o"],
                    {"tp": F.col("_pos"), "fp": F.col("_neg")}, exclusive=False,
                    rows_per_bucket=rows_per_bucket)
    tp, fp = F.col("tp"), F.col("fp")
    return g.select("threshold", tp.alias("tp"), fp.alias("fp"),
                    _div0(tp, F.lit(P)).alias("tpr"), _div0(fp, F.lit(N)).alias("fpr"),
                    _div0(tp, tp + fp).alias("precision"), _div0(tp, F.lit(P)).alias("recall"))


def pr_curve(df: DataFrame, score: str, label: str, rows_per_bucket: int = 1 << 20) -> DataFrame:
    """MT-4: precision-recall points (one per distinct threshold)."""
    return roc_curve(df, score, label, rows_per_bucket).select("threshold", "precision", "recall")


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """MT-5: per class precision / recall / f1 / support, plus macro and
    weighted averages: ``class, precision, recall, f1, support``."""
    c = confusion(df, label, pred)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    # class 1 sees (tp, fp, fn); class 0 sees (tn, fn, fp)
    p1, r1, f1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    s1, s0 = (tp + fn), (tn + fp)
    n = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))
    return c.select(F.inline(F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _div0(p0 * s0 + p1 * s1, n), _div0(r0 * s0 + r1 * s1, n),
            _div0(f0 * s0 + f1 * s1, n), n))))


def aggregate_folds(fold_metrics: DataFrame, by: Sequence[str] = ("model",),
                    metrics: Sequence[str] = METRICS) -> DataFrame:
    """MT-6: ``cv_<m>_mean`` and sample ``cv_<m>_std`` of every metric."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"cv_{m}_mean"), F.stddev_samp(m).alias(f"cv_{m}_std")]
    return fold_metrics.groupBy(*by).agg(*aggs) if by else fold_metrics.agg(*aggs)


def robustness(cv_auc, holdout_auc, good: float = 0.03, moderate: float = 0.08) -> Column:
    """MT-7: diagnosis from ``cv - holdout``: good / moderate / poor."""
    delta = _q(cv_auc) - _q(holdout_auc)
    return F.when(delta < good, F.lit("good")).when(delta < moderate, F.lit("moderate")) \
            .otherwise(F.lit("poor"))
