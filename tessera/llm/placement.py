"""Sharding through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size: ``(offset + i * skip) mod size`` with offset and skip hashed from the
shard's name.  The shards take turns; on its turn a shard claims its first
preferred slot that is still free (a shard of weight w takes w turns a round).
The full table gives every shard the same number of slots, give or take one a
weight, and when a shard comes or goes few slots change hands.

A row's slot is the hash of its key modulo the table size; the table (bounded
by ``size``, a parameter) is broadcast, so placing a row is one lookup and no
shuffle, however hot a key or source is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table size: a prime well above 100 times the shards, for an even fill.
SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def fill_table(shards: Sequence[str] | Mapping[str, int], size: int = SIZE) -> np.ndarray:
    """Index of the owning shard of every slot.  Shards are taken in the order
    of their names, so the table does not depend on how they are listed."""
    if not _is_prime(size):
        raise ValueError("the table size must be a prime")
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    if not weights or len(weights) > size or any(w < 1 for w in weights.values()):
        raise ValueError("between 1 and `size` shards with weights from 1 on are needed")
    names = sorted(weights)
    turns = []
    for i, name in enumerate(names):
        digest = hashlib.sha256(name.encode()).digest()
        offset = int.from_bytes(digest[:8], "little") % size
        skip = int.from_bytes(digest[8:16], "little") % (size - 1) + 1
        turns.append([i, offset, skip, weights[name]])
    table = np.full(size, -1, dtype=np.int32)
    free = size
    while free:
        for turn in turns:
            for _ in range(turn[3]):
                if not free:
                    break
                while table[turn[1]] >= 0:
                    turn[1] = (turn[1] + turn[2]) % size
                table[turn[1]] = turn[0]
                free -= 1
    return table


def slot_of(*keys: Column, size: int = SIZE) -> Column:
    """Slot of a row; null keys hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] | Mapping[str, int], size: int = SIZE,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with its ``slot`` and ``shard`` added (columns of those names are
    replaced).  Rows with equal keys share a shard; null keys are a key of
    their own; an empty table stays empty."""
    names = sorted(shards)
    table = fill_table(shards, size)
    rows = [(i, names[s]) for i, s in enumerate(table.tolist())]  # `size` rows, the proven bound of the broadcast
    own = "_slot"
    while own in df.columns or own in (slot, shard):
        own += "_"
    lookup = df.sparkSession.createDataFrame(rows, ["i", "name"]).select(
        F.col("i").cast("int").alias(own), F.col("name").alias(shard))
    base = df.withColumn(slot, slot_of(*[F.col(k) for k in keys], size=size)).drop(shard)
    return base.join(F.broadcast(lookup), F.col(slot) == F.col(own), "left").drop(own)


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write one folder per shard.  Rows are spread by slot within a shard first,
    so that a shard is written by many tasks."""
    placed.repartition(F.col(slot)).write.partitionBy(shard).parquet(path)


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def moved(before: Sequence[str], after: Sequence[str], size: int = SIZE) -> float:
    """Share of slots whose owner differs between two sets of shards."""
    a, b = (np.array(sorted(s))[fill_table(s, size)] for s in (before, after))
    return float((a != b).mean())
