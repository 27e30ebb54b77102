"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, bigint); ``root`` is
    the smallest node of the component.

    Alternating large-star and small-star steps: every node is hung below the
    smallest neighbour it knows, until nothing changes; the rounds grow with the
    logarithm of the graph.  Minima are combined before the shuffle, and the
    join that hands them back is an equi-join whose hubs adaptive execution
    splits.  Each round is written to the shared folder."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).distinct()
        # a node that hands its neighbours on keeps its own link to the minimum, which the first branch emits
        e = stage(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
