"""Shuffled copies of columns by keyed bijections on row positions (ML-10).

Every row gets its position 0 .. n-1 in key order once.  A *slot* is one shuffle
of one feature: a bijection of the positions says which row receives the value of
which other row.  The bijection is a balanced Feistel network in modular form: a
position is a cell of an ``a`` x ``b`` grid, and in turn each coordinate is moved
by a hash of the other one, modulo its side.  The grid has ``spare`` cells beyond
the n positions; a position that lands on one is sent through again, until it
lands on a position (cycle walking).  No path can meet more than ``spare`` such
cells, so that many more rounds suffice; the sides are chosen to keep it small.

So no shuffled order is sorted, and all slots of all features share the positions
and one equi-join on them, whose keys are unique on one side and held once per
slot on the other: no key is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import sample as SA

ROUNDS = 4
#: Slot of the rows as they are.
AS_IS = -1
#: Seed of the round function; slots differ by their round keys.
ROUND_SEED = 7
MAX_SIDES = 1 << 20


@dataclass(frozen=True)
class Grid:
    """``a * b`` cells for ``n`` positions, ``spare`` of them beyond the positions."""
    n: int
    a: int
    b: int

    @property
    def spare(self) -> int:
        return self.a * self.b - self.n


def grid(n: int) -> Grid:
    """The grid with the fewest spare cells among those whose shorter side lies between
    about half the square root of ``n`` and the root (at most ``MAX_SIDES`` are tried)."""
    root = max(1, math.isqrt(n))
    sides = np.arange(max(1, root // 2, root - MAX_SIDES + 1), root + 1, dtype=np.int64)
    spare = -n % sides
    a = int(sides[np.flatnonzero(spare == spare.min())[-1]])  # the most balanced of equals
    return Grid(n, a, -(-n // a))


def round_keys(slot: int, seed: int) -> list[int]:
    """A 32-bit key for each round of a slot."""
    def mixed(k: int) -> int:
        h = k % SA.MOD32 ^ k >> 32 ^ SA.mixed_seed(seed)
        for _ in range(2):
            h = (h ^ h >> 16) * SA.HASH_MULT % SA.MOD32
        return h ^ h >> 16
    return [mixed(slot * ROUNDS + r) for r in range(ROUNDS)]


def _pass(df: DataFrame, g: Grid, x: str) -> DataFrame:
    """``x`` through the network once, as separate projections, so that no expression
    holds more than one round."""
    d = df.withColumns({"_pl": F.expr(f"{x} div {g.b}"), "_pr": F.col(x) % g.b})
    for r in range(ROUNDS):
        moved, other, side = ("_pr", "_pl", g.b) if r % 2 == 0 else ("_pl", "_pr", g.a)
        h = SA.mix64(F.col(other).bitwiseXOR(F.col(f"_k{r}")), ROUND_SEED)
        d = d.withColumn("_ph", h).withColumn(moved, (F.col(moved) + F.col("_ph")) % side)
    return d.withColumn("_py", F.col("_pl") * g.b + F.col("_pr")).drop("_pl", "_pr", "_ph")


def permuted_position(df: DataFrame, g: Grid, position: str, name: str) -> DataFrame:
    """Add the image of ``position`` under the bijection of a row's round keys
    (columns ``_k0`` ...), a position again."""
    d = _pass(df, g, position).withColumnRenamed("_py", name)
    for _ in range(g.spare):  # sides are chosen so that this is a handful
        d = _pass(d, g, name).withColumn(name, F.when(F.col(name) >= g.n, F.col("_py")).otherwise(F.col(name))).drop("_py")
    return d


def shuffled_copies(df: DataFrame, features: Sequence[str], key: str, repeats: int, seed: int = 42,
                    positions: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``repeats`` copies of ``df`` per feature in which that feature alone is
    shuffled over all rows, and ``df`` as it is: all columns, ``_slot`` (feature
    number times ``repeats`` plus repeat; ``AS_IS``).

    ``key`` is a unique number; columns of ``df`` must not start with ``_``.  Nulls
    move like other values.  ``positions``: ``df`` with ``_pos`` if there is one, and ``n`` rows."""
    d = SA.ordered_index(df, [key], name="_pos") if positions is None else positions
    n = df.count() if n is None else n
    g = grid(max(1, n))
    kinds: list = []  # one value column per data type
    for f in features:
        if df.schema[f].dataType not in kinds:
            kinds.append(df.schema[f].dataType)
    place = {f: kinds.index(df.schema[f].dataType) for f in features}
    slots = [(AS_IS, AS_IS, [0] * ROUNDS)] + [(i * repeats + r, i, round_keys(i * repeats + r, seed))
                                              for i in range(len(features)) for r in range(repeats)]
    table = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(i).alias("feature"),
                               *[F.lit(k).cast("long").alias(f"k{r}") for r, k in enumerate(keys)]) for s, i, keys in slots])

    def value(kind: int) -> Column:
        out = F.lit(None)
        for i, f in enumerate(features):
            if place[f] == kind:
                out = F.when(F.col("_s.feature") == i, F.col(f"`{f}`")).otherwise(out)
        return out.cast(kinds[kind])

    given = d.select("_pos", *[F.col(f"`{f}`") for f in features], F.explode(table).alias("_s")).select(
        "_pos", F.col("_s.slot").alias("_slot"), F.col("_s.feature").alias("_feature"),
        *[F.col(f"_s.k{r}").alias(f"_k{r}") for r in range(ROUNDS)], *[value(k).alias(f"_v{k}") for k in range(len(kinds))])
    given = permuted_position(given, g, "_pos", "_image").select(
        # never null, and declared so: a null check of the join key would repeat all rounds in one expression
        F.coalesce(F.when(F.col("_slot") == AS_IS, F.col("_pos")).otherwise(F.col("_image")), F.lit(-1)).alias("_to"), "_slot",
        *[f"_v{k}" for k in range(len(kinds))])
    given = SA.spread(given, n * len(slots), "_to")
    # the rows of a partition are few beside their copies, which then need no sort
    joined = d.hint("shuffle_hash").join(given, F.col("_pos") == F.col("_to")) \
        .withColumn("_feature", F.when(F.col("_slot") != AS_IS, F.expr(f"_slot div {repeats}")))
    number = {f: i for i, f in enumerate(features)}
    return joined.select("_slot", *[F.when(F.col("_feature") == number[c], F.col(f"_v{place[c]}")).otherwise(F.col(f"`{c}`")).alias(c)
                                    if c in number else F.col(f"`{c}`") for c in df.columns])
