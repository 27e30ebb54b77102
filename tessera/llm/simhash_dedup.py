"""SimHash near-dedup with a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint of its word shingles.  Equal
fingerprints are one class.  Two codes that differ in at most r bits agree on
one of r + 1 blocks of bits, so each class is sent to r + 1 groups, one per
block value, and every link lies inside some group.  A group that holds more
than ``group_rows`` codes is split the same way on its free bits (its codes
agree on the rest), again and again, so no task gets an unbounded group and no
link is lost.  Groups are searched with :class:`~tessera.llm.gray_index.GrayIndex`;
a group returns a spanning forest of its links, never all pairs, and the forests
are joined into components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, map_texts, row_key, stage, text_of
from tessera.llm.components import connected_components
from tessera.llm.gray_index import GrayIndex, gray_rank

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

SEED = 42
#: Rows of whole groups searched together.
CHUNK_ROWS = 100_000
#: Times a hot group is split.  After four splits the codes of a group of radius
#: 4 agree on 38 or more bits; what still is large then is searched as it is.
SPLITS = 4
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash: bit set if set in over half the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - k + 1].tolist()
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(begin, end[k - 1:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        part = hashes[at:at + COUNT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``id, rk, fp`` per row; null texts are empty, null ids rank below every id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "rk", "fp"])

    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), row_key(F.col(text)).alias("rk"),
                    text_of(text).alias("text"))
    return map_texts(d, run, "id bigint, rk bigint, fp bigint")


def blocks(fixed: int, n: int) -> list[int]:
    """``n`` masks: the free bits of ``fixed`` cut into n parts, each added to it."""
    free = [i for i in range(64) if not fixed >> i & 1]
    parts = [free[len(free) * j // n:len(free) * (j + 1) // n] for j in range(n)]
    return [fixed | sum(1 << i for i in p) for p in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forests(radius: int):
    def linked(mask, value, code) -> pa.RecordBatch:
        group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]) - 1
        many = np.bincount(group)[group] > 1
        group, code = group[many], code[many].view(np.uint64)
        order = np.lexsort((gray_rank(code), group))
        group, code = group[order], code[order]
        root = GrayIndex(code, group).roots(radius) if len(code) else np.empty(0, np.int64)
        hangs = root != np.arange(len(code))
        a, b = code[hangs].view(np.int64), code[root[hangs]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= CHUNK_ROWS:  # all but the last group, which may go on
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(last):
                    at = last[-1] + 1
                    yield linked(*[h[:at] for h in held])
                    held = [h[at:] for h in held]
        if len(held[0]):
            yield linked(*held)

    return run


def links(codes: DataFrame, radius: int, group_rows: int = 20_000) -> DataFrame:
    """Edges ``a, b`` between distinct ``fp`` that connect exactly those that
    chains of at most ``radius`` differing bits connect."""
    masks = blocks(0, radius + 1)
    keyed = codes.select(F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"), "fp") \
        .select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    done = []
    for _ in range(SPLITS):
        hot = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
        hot = stage(hot.select("mask", "value"), "hot-groups")
        if hot.isEmpty():
            break
        done.append(keyed.join(hot, ["mask", "value"], "left_anti"))
        pairs = [(_signed(m), _signed(k)) for m in masks for k in blocks(m, radius + 1)]
        children = F.broadcast(codes.sparkSession.createDataFrame(pairs, "mask long, child long"))  # (radius + 1)^splits rows
        keyed = stage(keyed.join(hot, ["mask", "value"], "left_semi").join(children, "mask")
                      .select(F.col("child").alias("mask"), F.col("child").bitwiseAND(F.col("fp")).alias("value"), "fp"),
                      "split-groups")
        masks = [k for m in masks for k in blocks(m, radius + 1)]
    for part in done:
        keyed = keyed.unionAll(part)
    grouped = keyed.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return grouped.mapInArrow(_forests(radius), "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4,
                  group_rows: int = 20_000) -> DataFrame:
    """``doc_id, rk, fp, component_id, component`` per row of ``docs``;
    ``component_id`` is the smallest id that a chain of links reaches, the row's
    own included, ``component`` the smallest fingerprint of the chain, which
    tells components apart whatever their ids, and ``rk`` the hash of the text.

    Texts of fewer words than ``shingle`` are one shingle; null and empty texts
    have fingerprint zero, which links like any other.  Null ids rank below
    every id, so their component's id is null.  Repeated rows get equal rows.
    An empty table gives an empty result."""
    fps = stage(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    comps = connected_components(links(classes.select("fp"), radius, group_rows))
    comps = stage(comps.join(classes, comps["node"] == classes["fp"]).select("node", "root", "first"), "components")
    least = comps.groupBy("root").agg(F.min("first").alias("least"))
    named = comps.join(least, "root").select("node", "root", "least")
    classes = classes.join(named, classes["fp"] == named["node"], "left") \
        .select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("least", "first").alias("component_id"))
    out = fps.join(classes, "fp")
    null = F.lit(NULL_ID)
    return out.select(F.nullif("id", null).alias("doc_id"), "rk", "fp", F.nullif("component_id", null).alias("component_id"),
                      "component")


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query: the fingerprint as 16 hex digits."""
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
