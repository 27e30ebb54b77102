"""Exact order statistics of an integer column without sorting or shuffling
rows.

A rank is found digit by digit, like a radix sort that only counts: each pass
counts the rows per next 12-bit digit inside the few intervals that still hold
a wanted rank (a narrow scan, partial counts, at most ``ranks x 4096`` rows to
the driver) and descends into one of them.  Keys of b significant bits take
ceil(b / 12) passes.  Segments (folds, splits, batches) then are comparisons
with the boundaries found: no row moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 12
LOWEST = -(1 << 63)


def _unsigned(v: int) -> int:
    return v - LOWEST


class RepeatedKey(ValueError):
    """A key that must be unique stands in several rows (or is null)."""


def find(df: DataFrame, value: Column, ranks: Callable[[int], Sequence[int]], by: str | None = None,
         tie: Column | None = None, together: bool = False) -> dict:
    """``{class: (n, [(value, tie, after) or None, ...])}``: for every class of
    ``by`` the row at each 0-based rank of ``ranks(n)`` in order of ``value``
    (bigint), then ``tie``; None where the rank is n or more.  ``tie`` is None in
    the result where the first row of that value is meant.  Null values rank first.
    The classes are the strata of a split: few, and their counts reach the driver.

    A rank may fall inside the rows of one ``(value, tie)``.  With ``together``
    the boundary then moves to the nearer end of these rows (``after``: behind
    them), so that they stay on one side; else :class:`RepeatedKey` is raised."""
    cls = F.col(f"`{by}`") if by else F.lit(None).cast("string")
    v = F.coalesce(value.cast("long"), F.lit(LOWEST))
    u = v.bitwiseXOR(F.lit(LOWEST))  # unsigned order
    d = df.select(cls.alias("c"), u.alias("u"), *([tie.alias("t")] if tie is not None else []))
    sizes = df.select(cls.alias("c"), v.alias("v")).groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    if not sizes:
        return {}
    low, high = min(_unsigned(r["lo"]) for r in sizes), max(_unsigned(r["hi"]) for r in sizes)
    bits = (low ^ high).bit_length()
    wanted = {r["c"]: list(ranks(r["n"])) for r in sizes}
    n = {r["c"]: r["n"] for r in sizes}
    # (class, index) -> (prefix so far, rank inside it, rows in it)
    at = {(c, i): (low >> bits, r, n[c]) for c, rs in wanted.items() for i, r in enumerate(rs) if 0 <= r < n[c]}
    shift = bits
    while shift and at:
        before, shift = shift, max(0, shift - DIGIT)
        open_ = sorted({(c, p) for (c, _), (p, _, _) in at.items()}, key=repr)
        rows = d
        if before < bits:
            side = d.sparkSession.createDataFrame([(c, p + (LOWEST << 1) if p >> 63 else p) for c, p in open_],
                                                  d.select(F.col("c").alias("oc"), F.col("u").alias("op")).schema)
            rows = d.join(F.broadcast(side), F.col("c").eqNullSafe(F.col("oc"))
                          & (F.shiftrightunsigned("u", before) == F.col("op")))
        counts: dict = {}
        for r in rows.groupBy("c", F.shiftrightunsigned("u", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            p = r["p"] % (1 << 64)
            counts.setdefault((r["c"], p >> (before - shift)), []).append((p, r["n"]))
        for k, (p, rank, _) in at.items():
            for q, m in sorted(counts[(k[0], p)]):
                if rank < m:
                    at[k] = (q, rank, m)
                    break
                rank -= m
    out = {}
    for c, rs in wanted.items():
        found: list = []
        for i, _ in enumerate(rs):
            if (c, i) not in at:
                found.append(None)
                continue
            p, rank, m = at[(c, i)]
            t, after = None, False
            if tie is not None and (rank or m > 1):
                # the ties of one value: as many as hash collisions, each with its rows counted
                same = d.where(F.col("c").eqNullSafe(F.lit(c)) & (F.col("u") == F.lit(p - (1 << 64) if p >> 63 else p)))
                for t, size in same.groupBy("t").agg(F.count(F.lit(1))).orderBy("t").collect():  # noqa: B007
                    if rank < size:
                        break
                    rank -= size
                if rank and not together:
                    raise RepeatedKey(f"key {t!r} stands in {size} rows; name the column as group to keep such rows together")
                after = 2 * rank > size
            found.append((p + LOWEST, t, after))
        out[c] = (n[c], found)
    return out


def segment(df: DataFrame, value: Column, found: dict, by: str | None = None, tie: Column | None = None,
            name: str = "_segment", size: str | None = None) -> DataFrame:
    """Add ``name``: how many of its class' boundaries a row has reached (and
    ``size``, the rows of its class).  One narrow projection over a broadcast
    row per class."""
    v = F.coalesce(value.cast("long"), F.lit(LOWEST))
    most = max((len(b) for _, b in found.values()), default=0)

    def reached(i: int) -> Column:
        past = v > F.col(f"_v{i}")
        if tie is not None:
            later = F.when(F.col(f"_a{i}"), tie > F.col(f"_t{i}")).otherwise(F.col(f"_t{i}").isNull() | (tie >= F.col(f"_t{i}")))
            past = past | ((v == F.col(f"_v{i}")) & F.coalesce(later, F.lit(False)))
        else:
            past = past | (v == F.col(f"_v{i}"))
        return F.coalesce(past, F.lit(False)).cast("int")

    ctype = df.schema[by].dataType.simpleString() if by else "string"
    ttype = df.select(tie.alias("t")).schema["t"].dataType.simpleString() if tie is not None else "long"
    rows = [(c, n, *[x for i in range(most) for x in ((b[i] if i < len(b) and b[i] else (None, None, False)))])
            for c, (n, b) in found.items()]
    schema = ", ".join([f"_c {ctype}", "_n long", *[f"_v{i} long, _t{i} {ttype}, _a{i} boolean" for i in range(most)]])
    side = df.sparkSession.createDataFrame(rows, schema)
    on = F.col(f"`{by}`").eqNullSafe(F.col("_c")) if by else F.col("_c").isNull()
    out = df.join(F.broadcast(side), on, "left")
    seg = sum((reached(i) for i in range(most)), F.lit(0))
    out = out.withColumn(name, seg)
    if size:
        out = out.withColumn(size, F.col("_n"))
    return out.drop("_c", "_n", *[f"_{x}{i}" for x in "vta" for i in range(most)])
