"""Pairwise moments of many numeric columns in one pass (AG-7, ML-12).

A row is one array of d numbers.  Every task adds up, per class, the products of
its rows as d x d matrices (X'X and, for missing elements, the masked sums), cut
into blocks of columns.  Equal blocks are added in two steps, first within one of
about the square root of the number of tasks' slots, then over the slots, so no
task gets a block from every other.  The plan does not grow with d or with the
number of classes, and one job serves them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

BLOCK = 128
ROWS = 2048
#: What a block holds for columns i and j, over rows where both are present.
MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


class _Sums:
    """V'V, X'V, (X*X)'V and X'X of the rows seen (V marks present elements)."""

    def __init__(self, d: int):
        self.vv, self.xv, self.qv, self.xx = (np.zeros((d, d)) for _ in range(4))

    def add(self, x: np.ndarray, present: np.ndarray) -> None:
        self.xx += x.T @ x
        if present.all():
            self.vv += len(x)
            self.xv += x.sum(axis=0)[:, None]
            self.qv += (x * x).sum(axis=0)[:, None]
        else:
            v = present.astype(np.float64)
            self.vv += v.T @ v
            self.xv += x.T @ v
            self.qv += (x * x).T @ v

    def block(self, a: slice, b: slice) -> np.ndarray:
        return np.stack([self.vv[a, b], self.xv[a, b], self.xv[b, a].T, self.qv[a, b], self.qv[b, a].T, self.xx[a, b]])


def _partial(d: int, shift: np.ndarray, slots: int, block: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                flat = part.column(1).flatten()
                if len(flat) != part.num_rows * d:
                    raise ValueError(f"every array must have {d} elements")
                present = np.asarray(flat.is_valid()).reshape(-1, d)
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                x = np.where(present, x - shift, 0.0)
                codes = part.column(0).dictionary_encode(null_encoding="encode")
                which = codes.indices.to_numpy(zero_copy_only=False)
                for k, value in enumerate(codes.dictionary.to_pylist()):
                    mine = which == k
                    if mine.any():
                        sums.setdefault(value, _Sums(d)).add(x[mine], present[mine])
        slot = TaskContext.get().partitionId() % slots
        edges = [slice(s, min(d, s + block)) for s in range(0, d, block)]
        for value, s in sums.items():
            for a in range(len(edges)):
                for b in range(a, len(edges)):
                    row = [[value], [slot], [a], [b], [s.block(edges[a], edges[b]).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)],
                                                     schema=schema)
    return run


def _added(t: pa.Table) -> pa.Table:
    total = np.zeros(len(t.column("m")[0].as_buffer()) // 8)
    for m in t.column("m"):
        total += np.frombuffer(m.as_buffer())
    first = t.slice(0, 1)
    return first.set_column(first.schema.get_field_index("m"), first.schema.field("m"), pa.array([total.tobytes()], pa.binary()))


def _cells(d: int, block: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, a, b, m in zip(*[batch.column(c) for c in ("by", "a", "b", "m")], strict=True):
                a, b = a.as_py() * block, b.as_py() * block
                wide = min(d, b + block) - b
                cells = np.frombuffer(m.as_buffer()).reshape(len(MOMENTS), -1)
                i, j = a + np.arange(cells.shape[1]) // wide, b + np.arange(cells.shape[1]) % wide
                upper = i <= j
                cols = [pa.array([value.as_py()] * int(upper.sum()), schema.field(0).type),
                        pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(c[upper]) for c in cells], schema=schema)
    return run


def vector_of(df: DataFrame, cols: Sequence[str] | str) -> Column:
    """An array column, or several numeric columns as one array of doubles."""
    if isinstance(cols, str):
        return F.col(f"`{cols}`").cast("array<double>")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def pair_moments(df: DataFrame, vector: Column, by: Column | None = None, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """``by, i, j, n, sx, sy, sxx, syy, sxy`` for positions i <= j of the array,
    over the rows of a class where both elements are present; and the numbers that
    were subtracted from the elements first (one present value each, which keeps
    the sums of squares small and those of a constant exactly zero).  Rows whose
    array is null are left out; arrays must have equally many elements.  A NaN makes
    every sum of products with its element NaN."""
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = df.select((F.lit(0) if by is None else by).alias("by"), vector.alias("x")).where("x IS NOT NULL")
    some = [r["x"] for r in rows.select("x").take(100)]
    d = len(some[0]) if some else 0
    shift = np.array([next((r[i] for r in some if r[i] is not None and math.isfinite(r[i])), 0.0) for i in range(d)])
    slots = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    key = rows.schema["by"]
    whole = [StructField(c, IntegerType()) for c in ("slot", "a", "b")]
    parts = StructType([StructField("by", key.dataType), *whole, StructField("m", BinaryType())])
    out = rows.mapInArrow(_partial(d, shift, slots, block, to_arrow_schema(parts)), parts)
    out = out.groupBy("by", "slot", "a", "b").applyInArrow(_added, parts)
    out = out.groupBy("by", "a", "b").applyInArrow(_added, parts)
    cells = StructType([StructField("by", key.dataType), StructField("i", IntegerType()), StructField("j", IntegerType())])
    for c in MOMENTS:
        cells = cells.add(c, "double")
    return out.mapInArrow(_cells(d, block, to_arrow_schema(cells)), cells), shift


def correlation_cells(df: DataFrame, cols: Sequence[str] | str, block: int = BLOCK) -> DataFrame:
    """AG-7 for any number of columns: pairwise-complete Pearson ``i, j, corr`` of
    every ordered pair of positions; null where a side does not vary."""
    m, _ = pair_moments(df, vector_of(df, cols), block=block)
    n = F.col("n")
    vx = F.when(n > 0, F.col("sxx") - F.col("sx") * F.col("sx") / n)
    vy = F.when(n > 0, F.col("syy") - F.col("sy") * F.col("sy") / n)
    varies = (vx > F.col("sxx") * 1e-13) & (vy > F.col("syy") * 1e-13)
    m = m.select("i", "j", F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)).alias("corr"))
    return m.unionAll(m.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))


def class_scatter(df: DataFrame, vector: Column, label: Column, block: int = BLOCK,
                  keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """``i, j, within`` (products of deviations from the own class's mean, summed
    over all classes, i <= j) and ``label, i, n, mean``, of the rows that have every
    element.  Who reads both asks to ``keep`` the moments, so that one pass serves
    both, and frees them with :func:`release`."""
    complete = df.where(vector.isNotNull() & ~F.exists(vector, lambda e: e.isNull()))
    m, shift = pair_moments(complete, vector, label, block)
    if keep:
        m = m.persist()
    within = m.groupBy("i", "j").agg(F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("within"))
    base = F.array(*[F.lit(float(s)) for s in shift])
    means = m.where("i = j").select(F.col("by").alias("label"), "i", F.col("n").cast("long").alias("n"),
                                    (F.col("sx") / F.col("n") + F.get(base, F.col("i"))).alias("mean"))
    means._moments = m
    return within, means


def release(means: DataFrame) -> None:
    """Free what :func:`class_scatter` kept for its two results."""
    means._moments.unpersist()
