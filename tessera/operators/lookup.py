"""Keyed joins of two large tables without a shuffle at join time (JN-3)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` written as a table of ``buckets`` hash buckets of ``key``, one file
    each, sorted by it, and read back.  Tables of equally many buckets of one key
    join without an exchange.  The rows are shuffled once, here."""
    spark = df.sparkSession
    name = name or f"tessera_{uuid.uuid4().hex}"
    df.repartition(buckets, F.col(f"`{key}`")).write.bucketBy(buckets, key).sortBy(key).format("parquet") \
        .option("path", path or scratch_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def row_lookup(rows: DataFrame, labels: DataFrame, key: str, buckets: int = 16) -> DataFrame:
    """JN-3: the columns of ``rows`` with those of ``labels`` (row -> cluster), for
    keys that both have.  Both sides may be as large as the data; a side that is a
    bucketed table of this key already is not written again.  Rows whose key is
    null find nothing."""
    def ready(df: DataFrame) -> DataFrame:
        return df if getattr(df, "_bucketed_by", None) == (key, buckets) else bucketed(df, key, buckets)
    left, right = ready(rows), ready(labels)
    return left.hint("merge").join(right, key)


def as_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """:func:`bucketed`, remembered so that :func:`row_lookup` uses it as it is."""
    out = bucketed(df, key, buckets)
    out._bucketed_by = (key, buckets)
    return out


def nearest_centre(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]], name: str = "cluster") -> DataFrame:
    """Number of the nearest centre (squared Euclidean, the first of equals);
    null where a column is missing.  Centres are few and travel as literals."""
    def distance(c: Sequence[float]) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(f"`{x}`").cast("double") - F.lit(float(v))) ** 2
                                           for x, v in zip(cols, c, strict=True)])
    away = F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    complete = reduce(lambda a, b: a & b, [F.col(f"`{x}`").isNotNull() for x in cols])
    return df.withColumn(name, F.when(complete, F.array_min(away)["i"]))
