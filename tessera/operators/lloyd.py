"""Many K-Means runs over the same points at once (ML-13, ML-14).

A K-Means fit is a chain of short jobs, one per iteration, and a search over ``k`` and
restarts is dozens of such chains.  Here one job is an iteration of every run that has
not converged: a task reads its points once and adds them up around the centres of all
runs; the sums of a run (one row per task) are added in one group.  The first centres
are those of Spark's own ``KMeans`` (k-means||), and a run ends as a fit there does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int]


def first_centres(z: DataFrame, col: str, runs: Sequence[Run], parallelism: int = 8) -> dict[Run, np.ndarray]:
    """Centres that Spark's ``KMeans`` starts from, for every (k, seed)."""
    def one(run: Run) -> np.ndarray:
        m = KMeans(k=run[0], seed=run[1], featuresCol=col, maxIter=0).fit(z)
        return np.array([c for c in m.clusterCenters()], dtype=np.float64)
    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        return dict(zip(runs, ex.map(one, runs)))


def _points(batch: pa.RecordBatch, at: int) -> np.ndarray:
    col = batch.column(at)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance)."""
    away = (centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)
    best = away.argmin(axis=1)
    return best, np.maximum(away[np.arange(len(x)), best] + (x * x).sum(axis=1), 0.0)


def _step(centres: Sequence[np.ndarray]) -> Callable:
    """Per task and run: for each centre the sum and number of its points, and the cost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), c.shape[1] + 2)) for c in centres]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch, 0)
            for s, c in zip(sums, centres, strict=True):
                best, cost = _nearest(x, c)
                mine = np.zeros((len(x), len(c)))
                mine[np.arange(len(x)), best] = 1.0
                s[:, :-2] += mine.T @ x
                s[:, -2] += mine.sum(axis=0)
                s[:, -1] += mine.T @ cost
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())],
                                         names=["run", "m"])
    return run


def _added(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_buffer()) for m in t.column("m"))
    return pa.table({"run": t.column("run").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})


def fit_all(z: DataFrame, col: str, runs: Sequence[Run], max_iter: int = 20, tol: float = 1e-4) -> dict[Run, tuple[float, np.ndarray]]:
    """``{(k, seed): (cost, centres)}`` of Lloyd's iterations on the kept table ``z``
    (vector column ``col``).  As in Spark's ``KMeans`` a run ends when every centre moved
    by ``tol`` at most, a centre without points stays, and the cost is that of the last
    assignment."""
    centres = first_centres(z, col, list(dict.fromkeys(runs)))
    cost = {r: 0.0 for r in centres}
    points = z.select(vector_to_array(F.col(col)).alias("_x"))
    going = list(centres)
    for _ in range(max_iter):
        if not going:
            break
        sums = points.mapInArrow(_step([centres[r] for r in going]), "run int, m binary") \
            .groupBy("run").applyInArrow(_added, "run int, m binary").collect()
        still = []
        for row in sums:
            r = going[row["run"]]
            old = centres[r]
            s = np.frombuffer(row["m"]).reshape(len(old), -1)
            full = s[:, -2] > 0
            new = old.copy()
            new[full] = s[full, :-2] / s[full, -2:-1]
            cost[r], centres[r] = float(s[:, -1].sum()), new
            if (((new - old) ** 2).sum(axis=1) > tol * tol).any():
                still.append(r)
        going = [r for r in going if r in still]
    return {r: (cost[r], centres[r]) for r in centres}


def best_of(fits: Mapping[Run, tuple[float, np.ndarray]], k: int) -> tuple[float, np.ndarray]:
    """The run of ``k`` centres with the lowest cost (the first seed of equals)."""
    return min((fits[r] for r in sorted(fits) if r[0] == k), key=lambda f: f[0])


def assigned(z: DataFrame, col: str, centres: np.ndarray, name: str) -> DataFrame:
    """``z`` without ``col``, with its points as the array ``_x`` and the number of the
    nearest centre as ``name``."""
    d = z.withColumn("_x", vector_to_array(F.col(col))).drop(col)
    at = d.columns.index("_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _nearest(_points(batch, at), centres)[0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32())], names=[*batch.schema.names, name])
    return d.mapInArrow(run, d.withColumn(name, F.lit(0)).schema)
