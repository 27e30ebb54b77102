"""Removal of repeated passages by a rolling-hash parse of the corpus.

A string of ``length`` bytes is a *window*.  Rolling-hash triggers cut every
text into phrases: the anchor of a window is the place with the smallest rolling
hash (over ``GRAM`` bytes) among its first ``reach`` places, leftmost of equals.
The anchor depends on the window's bytes alone, so equal windows have their
anchors at the same offset, and neighbouring windows share theirs: a run of
windows with one anchor is a *phrase*.  Two numbers describe a phrase.  Its
*core* is the hash of the ``length - reach + 1`` bytes from the anchor on, which
all its windows contain; its *body* is the hash of all its bytes.

The dictionary of phrases then settles nearly all windows without looking at
them: a phrase whose core stands nowhere else has no repeated window, a phrase
whose body stands elsewhere has only repeated ones.  What remains are the
phrases at the edges of repeated passages; of each distinct one a single
representative is taken and its windows are ranked by their hashes among those
of the same core.  The verdicts of a representative hold for all equal phrases
and are read back along the parse.

Counts are combined before every shuffle, joins are equi-joins on hashes, long
texts are parsed in segments, and no task holds more than ``CHUNK_BYTES`` of
text besides the text at hand.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, covered, map_texts, release, stage, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

GRAM = 32
CHUNK_BYTES = 1 << 20
#: Rolling hash: sum of TABLE[byte] * BASE^position, modulo 2^64.  The table
#: comes from a seeded generator.
BASE = 0x9E3779B97F4A7C15
_TABLES: dict = {}
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _byte_values() -> np.ndarray:
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = np.random.default_rng(20_400).integers(0, 1 << 64, 256, dtype=np.uint64)
    return _TABLES["bytes"]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling; kept per worker."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            have[done:2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _TABLES[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _HALF)) * _MULTIPLIER
    x = (x ^ (x >> _HALF)) * _MULTIPLIER
    return x ^ (x >> _HALF)


class Rolling:
    """Hashes of all substrings of a sequence of symbols in constant time each."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers(BASE, n + 1)[:n], out=self.prefix[1:])
        self.back = _powers(pow(BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.back[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block-wise running minima."""
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def byte_symbols(data: bytes) -> np.ndarray:
    return _byte_values()[np.frombuffer(data, np.uint8)]


def word_symbols(data: bytes) -> np.ndarray:
    """A hash of every word (bytes between runs of space and \\x09-\\x0D)."""
    buffer = np.frombuffer(data, np.uint8)
    inside = ~((buffer == 0x20) | ((buffer >= 0x09) & (buffer <= 0x0D)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    return mix(Rolling(_byte_values()[buffer]).of(start, size) ^ mix(size.astype(np.uint64)))


SYMBOLS = {"bytes": byte_symbols, "words": word_symbols}


def parse(texts: list[np.ndarray], length: int, reach: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Phrases of ``texts`` (symbols): text index, start, windows, core and body hash."""
    data = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    windows = np.maximum(size - length + 1, 0)
    n = int(windows.sum())
    if not n:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    rolling = Rolling(data)
    place = np.arange(len(data) - gram + 1)
    trigger = mix(rolling.of(place, gram)) & ~np.uint64(0xFFFFFFFF) | place.astype(np.uint64)
    anchor_of = sliding_min(trigger, reach)
    text = np.repeat(np.arange(len(texts)), windows)
    x = np.arange(n) + np.repeat(start - (np.cumsum(windows) - windows), windows)
    anchor = (anchor_of[x] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, n])
    x, anchor, text = x[first], anchor[first], text[first]
    core = mix(rolling.of(anchor, length - reach + 1))
    shape = (anchor - x).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
    body = mix(mix(rolling.of(x, count - 1 + length)) ^ mix(shape))
    return text, x - start[text], count, core, body


def _parser(unit: str, length: int, reach: int, gram: int):
    names = ["id", "rk", "start", "windows", "core", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            text, x, n, core, body = parse([h[3] for h in held], length, reach, gram)
            ids, rks, begins = (np.array([h[k] for h in held], np.int64) for k in range(3))
            cols = [ids[text], rks[text], begins[text] + x, n.astype(np.int32), core.view(np.int64), body.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        held: list = []
        size = 0
        symbols = SYMBOLS[unit]
        for batch in batches:
            for i, rk, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), strict=True):
                data = symbols(text.as_py().encode("utf-8", "surrogatepass"))
                for at in range(0, max(len(data) - length + 1, 0), CHUNK_BYTES):  # segments of a long text
                    part = data[at:at + CHUNK_BYTES + length - 1]
                    held.append((i, rk, at, part))
                    size += len(part)
                    if size >= CHUNK_BYTES:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _window_ranks(unit: str, length: int, held: list[str]):
    names = ["core", "body", "off", "rank", *held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = SYMBOLS[unit](text.as_py().encode("utf-8", "surrogatepass"))
                wanted = wanted.values.flatten()
                start, n, core, body, *rest = (c.to_numpy(zero_copy_only=False) for c in wanted)
                order = np.argsort(start, kind="stable")
                for part in np.array_split(order, max(1, int(n.sum()) // CHUNK_BYTES + 1)):
                    if not len(part):
                        continue
                    low, high = int(start[part].min()), int((start + n)[part].max()) + length - 1
                    for piece in ([part] if high - low <= 4 * CHUNK_BYTES else [[p] for p in part]):
                        low, high = int(start[piece].min()), int((start + n)[piece].max()) + length - 1
                        off = np.concatenate([np.arange(k) for k in n[piece]])
                        which = np.repeat(np.asarray(piece), n[piece])
                        rank = mix(Rolling(data[low:high]).of(start[which] - low + off, length))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(core[which]), pa.array(body[which]), pa.array(off.astype(np.int32)),
                             pa.array(rank.view(np.int64)), *[pa.array(r[which]) for r in rest]], names)

    return run


def _cutter(length: int, with_kept: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rk", *["kept"] * with_kept]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, spans, rk in zip(*batch.columns, strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                removed, runs, kept, at = 0, 0, hashlib.sha256(), 0
                out = []
                if spans.is_valid and len(spans.values):
                    s, e = (c.to_numpy(zero_copy_only=False) for c in spans.values.flatten())
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.r_[True, s[1:] > e[:-1]]
                    for a, b in zip(s[new].tolist(), e[np.r_[new[1:], True]].tolist(), strict=True):
                        out.append(data[at:a])
                        removed, runs, at = removed + b - a, runs + 1, b
                out.append(data[at:])
                for part in out:
                    kept.update(part)
                rows.append((i.as_py(), len(data), removed, runs, kept.hexdigest(), rk.as_py(), *[b"".join(out)] * with_kept))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def repeated_spans(d: DataFrame, unit: str, length: int, reach: int, gram: int, across: bool) -> DataFrame:
    """``_id, _rk, spans`` of the rows of ``d`` (``id, rk, text``) that hold a string
    of ``length`` units which starts anywhere else too or, ``across``, which another
    row holds: all such strings as spans ``s, e`` of units."""
    least = F.octet_length("text") >= (length if unit == "bytes" else 2 * length - 1)
    phrases = stage(map_texts(d.where(least), _parser(unit, length, reach, gram),
                              "id bigint, rk bigint, start bigint, windows int, core bigint, body bigint"), "phrases")
    doc = F.xxhash64("id", "rk")
    cores = phrases.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("low"), F.max("body").alias("high"),
                                        *[f(doc).alias(n) for f, n in ((F.min, "first"), (F.max, "last")) if across]) \
        .where("first <> last" if across else "n >= 2").select("core", (F.col("low") == F.col("high")).alias("whole"))
    cores = stage(cores, "cores")
    known = stage(phrases.join(cores, "core"), "repeated-cores")
    release(phrases, cores)
    edges = known.where("NOT whole")
    # one representative of each distinct phrase, with its number of copies or its first and last holder
    held = ["first", "last"] if across else ["times"]
    counts = [F.min(doc).alias("first"), F.max(doc).alias("last")] if across else [F.count(F.lit(1)).alias("times")]
    rep = edges.groupBy("core", "body").agg(*counts, F.min(F.struct("id", "rk", "start", "windows")).alias("r"))
    wanted = rep.groupBy(F.col("r.id").alias("_id"), F.col("r.rk").alias("_rk")).agg(F.collect_list(F.struct(
        F.col("r.start").alias("start"), F.col("r.windows").alias("windows"), "core", "body", *held)).alias("wanted"))
    ranks = d.join(wanted, (F.col("id") == F.col("_id")) & (F.col("rk") == F.col("_rk"))) \
        .dropDuplicates(["_id", "_rk"]).select("text", "wanted")
    ranks = stage(map_texts(ranks, _window_ranks(unit, length, held), "core bigint, body bigint, off int, rank bigint, "
                            + ", ".join(f"{h} bigint" for h in held)), "window-ranks")
    again = ranks.groupBy("core", "rank").agg(*([F.min("first").alias("first"), F.max("last").alias("last")] if across
                                                else [F.sum("times").alias("n")]))
    again = again.where("first <> last" if across else "n >= 2").select("core", "rank")
    offs = ranks.join(again, ["core", "rank"]).groupBy("core", "body").agg(F.sort_array(F.collect_list("off")).alias("offs"))
    offs = stage(offs, "repeated-windows")
    release(ranks)
    # runs of repeated windows, as spans
    zero = F.array().cast("array<struct<s:int,e:int>>")

    def grow(acc, o):
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] == o), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"),
                                                                      (o + 1).alias("e"))))
        ).otherwise(F.concat(acc, F.array(F.struct(o.alias("s"), (o + 1).alias("e")))))

    runs = offs.select("core", "body", F.explode(F.aggregate("offs", zero, grow)).alias("run"))
    spans = known.where("whole").select("id", "rk", F.col("start").alias("s"), (F.col("start") + F.col("windows")).alias("e")) \
        .unionAll(edges.join(runs, ["core", "body"]).select("id", "rk", (F.col("start") + F.col("run.s")).alias("s"),
                                                            (F.col("start") + F.col("run.e")).alias("e")))
    per_doc = spans.groupBy(F.col("id").alias("_id"), F.col("rk").alias("_rk")).agg(F.sort_array(F.collect_set(F.struct(
        "s", (F.col("e") + (length - 1)).alias("e")))).alias("spans"))
    per_doc = stage(per_doc, "spans")
    release(known, offs)
    return per_doc


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), text_of(text).alias("text")) \
        .select("id", F.xxhash64("text").alias("rk"), "text")


def shared_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 51, reach: int = 32) -> DataFrame:
    """``doc_id, rk, n_shared_words``: how many words of a row stand in a run of
    ``words`` words that another row (another id or text) holds too, whatever is
    between the words.  Rows without such a run are left out; ``rk`` is the hash of
    the row's text, null ids stay null."""
    gram = min(8, words - reach)
    if reach < 1 or gram < 1:
        raise ValueError("reach must be between 1 and words - 1")
    found = repeated_spans(_keyed(docs, doc_id, text), "words", words, reach, gram, across=True)
    return found.select(F.nullif("_id", F.lit(NULL_ID)).alias("doc_id"), F.col("_rk").alias("rk"),
                        covered(F.col("spans")).alias("n_shared_words"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, reach: int = 128,
                   with_kept: bool = True) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts
    anywhere else too, in the same text or another, judged on the input.

    Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed
    runs), ``kept_sha256``, ``rk`` (hash of the text) and, ``with_kept``, the
    remaining bytes.  Texts are UTF-8 bytes, null is empty; texts shorter than
    ``length`` lose nothing.  Repeated rows are separate texts, so each loses what
    the other holds; rows that share an id are told apart by their texts, null ids
    stay null.  An empty table gives an empty result."""
    if not GRAM + reach <= length:
        raise ValueError("length must be at least reach + %d" % GRAM)
    d = _keyed(docs, doc_id, text)
    per_doc = repeated_spans(d, "bytes", length, reach, GRAM, across=False)
    out = d.join(per_doc, (F.col("id") == F.col("_id")) & (F.col("rk") == F.col("_rk")), "left") \
        .select(F.nullif("id", F.lit(NULL_ID)).alias("id"), "text", "spans", "rk")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, rk bigint" + ", kept binary" * with_kept
    return map_texts(out, _cutter(length, with_kept), schema)
