"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is a smoothed bigram model over words and an end token,
``p(w | c) = (n(c, w) + mu p1(w)) / (n(c) + mu)``; ``p1`` is the add-half
probability of every word by its own count, of the end and of an unseen word.
Only if ``top_words`` is given, the words beyond that many share one class evenly.

The most frequent words have short codes and counts that every task knows; other
words are known by hashes.  Their counts are found by a shuffle of their own:
each task sends the hashes that a shard will meet, with their training counts, to
the hash's task, which adds them up and sends the shard the sum.

Each task turns its texts into (context, word) pairs
and deals them to shards by the hash of the context.  A shard counts the pairs
of training texts, builds its trie in a memory map and answers the pairs of all
texts by successor search; only sums per text leave it.  The number of
shards grows with the corpus, so a shard's size does not.  A context so frequent
that it would fill a shard is among the top words, whose counts every task
knows; its pairs are spread over several shards by the word as well, after equal
pairs of a text have been added up.

The order is two because a shard must hold all that a probability needs; a third
level takes half as many bytes again in the one shuffle.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, ascii_lower, map_texts, release, split_words, stage, text_of
from tessera.llm.elias_fano import Trie

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

U = np.uint64
#: Codes: top words by rank, then the start and end of a text; other words are
#: hashes with the highest bit set.
START, END = 65_000, 65_001
ESCAPE = 0xFFFF
TAIL = 1 << 63
_START, _END = np.array([START], U), np.array([END], U)
#: Pairs that a task turns into rows at a time.
CHUNK_PAIRS = 300_000


@dataclass(frozen=True)
class Unigrams:
    words: list[bytes]
    counts: np.ndarray  # of the top words
    tokens: int  # N, ends included
    types: int  # V, the end included
    texts: int
    own: bool = True  # words beyond the top ones have probabilities of their own

    def base(self, c):
        return np.log10(np.asarray(c, float) + 0.5)

    @property
    def base_total(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.types + 1))

    def log_p1(self) -> tuple[np.ndarray, float, float]:
        """log10 of p1 of the top words, of a word of the class (an unseen one
        where every word has its own), of the end."""
        if self.own:
            total = self.tokens + 0.5 * (max(1, self.types) + 1)
            return np.log10((self.counts + 0.5) / total), math.log10(0.5 / total), math.log10((self.texts + 0.5) / total)
        total = self.tokens + 0.5 * (len(self.words) + 2)
        rest = self.tokens - self.texts - float(self.counts.sum())
        others = max(0, self.types - 1 - len(self.words)) + 1
        return (np.log10((self.counts + 0.5) / total), math.log10((rest + 0.5) / total / others),
                math.log10((self.texts + 0.5) / total))


def count_words(train: DataFrame, top_words: int, own: bool = True) -> Unigrams:
    """``train`` has a column ``text``.  All texts are counted; the driver gets
    the totals and the most frequent words, ``top_words`` at most."""
    counts = stage(train.select(F.explode(split_words(ascii_lower(F.col("text")))).alias("word"))
                   .groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the lowest count, in eighths of an octave, that at most top_words words reach
    octave = F.floor(8 * F.log2(F.col("n").cast("double")))
    least, seen = None, 0
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("v")).collect(), reverse=True):
        seen += r["v"]
        if seen > top_words:
            break
        least = r["o"]
    top = [] if least is None else counts.where(octave >= least).collect()  # at most top_words rows
    top.sort(key=lambda r: (-r["n"], r["word"]))
    texts = train.count()
    release(counts)
    return Unigrams([r["word"].encode() for r in top], np.array([r["n"] for r in top], float),
                    total["n"] + texts, total["v"] + (texts > 0), texts, own)


class _Coder(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word) | TAIL


def _shard(context: np.ndarray, word: np.ndarray, parts: np.ndarray, shards: int) -> np.ndarray:
    """``parts``: over how many shards each top context is spread."""
    n = np.where(context < TAIL, parts[np.minimum(context, END).astype(np.int64)], 1).astype(U)
    h = (context + U(1)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    g = (word + U(1)) * U(0xBF58476D1CE4E5B9)
    g ^= g >> U(32)
    return ((h * U(0x94D049BB133111EB) >> U(33)) + g % n) % U(shards)


_DEALT = "shard int, chunk bigint, blob binary"
_ARRAYS = ("<i8", "<u4", "<u4", "u1", "<u4", "<u2", "<u8", "<u2", "<u8", "<u4")
_SUMS = ("<u4", "<f4", "<f8", "<u4")
_ASKED, _COUNTED = "home int, blob binary", "shard int, blob binary"
_ASK, _COUNT = ("<u8", "<u4", "<u4"), ("<u8", "<u4")


def pack(arrays, kinds: tuple[str, ...]) -> bytes:
    """Arrays of the given types in one compressed blob; two-byte codes are
    stored by byte, as their high bytes repeat."""
    import zstandard

    parts = []
    for x, kind in zip(arrays, kinds, strict=True):
        x = np.ascontiguousarray(x, kind)
        parts.append(x.view(np.uint8).reshape(-1, 2).T.tobytes() if kind == "<u2" else x.tobytes())
    head = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 4 * len(kinds)
    for size, kind in zip(np.frombuffer(data, "<u4", len(kinds)).tolist(), kinds, strict=True):
        part = data[at:at + size]
        if kind == "<u2":
            part = np.frombuffer(part, np.uint8).reshape(2, -1).T.tobytes()
        out.append(np.frombuffer(part, kind))
        at += size
    return out


def _narrow(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = codes >= TAIL
    return np.where(far, ESCAPE, codes), codes[far]


def _wide(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    out = near.astype(U)
    out[near == ESCAPE] = far
    return out


def _pairs(held: list):
    """Ids, training marks and sizes of a chunk's texts; text, context and word of its pairs."""
    ids, train, codes = zip(*held, strict=True)
    size = np.array([len(c) for c in codes]) + 1
    return (np.array(ids, np.int64), np.array(train, np.uint8), size, np.repeat(np.arange(len(codes)), size),
            np.concatenate([x for c in codes for x in (_START, c)]), np.concatenate([x for c in codes for x in (c, _END)]))


def _deal(unigrams, parts: np.ndarray, shards: int):
    """Texts to rows of one chunk and shard: the pairs, by text of the chunk.
    The first row of a chunk also lists its texts."""

    def flush(held: list, chunk: int) -> pa.RecordBatch:
        ids, train, size, doc, context, word = _pairs(held)
        times = np.ones(len(doc), np.uint32)
        # equal pairs of a text within contexts that are spread: one row with their number
        spread = (context < TAIL) & (word < TAIL)
        spread[spread] = parts[context[spread].astype(np.int64)] > 1
        if spread.any():
            key, times_s = np.unique(doc[spread].astype(U) << U(34) | context[spread] << U(17) | word[spread],
                                     return_counts=True)
            low = U((1 << 17) - 1)
            doc = np.concatenate([doc[~spread], (key >> U(34)).astype(np.int64)])
            context = np.concatenate([context[~spread], key >> U(17) & low])
            word = np.concatenate([word[~spread], key & low])
            times = np.concatenate([times[~spread], times_s.astype(np.uint32)])
        shard = _shard(context, word, parts, shards).astype(np.int64)
        order = np.lexsort((doc, shard))
        shard, doc, context, word, times = (x[order] for x in (shard, doc, context, word, times))
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        blobs, listed = [], (ids, size)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d, n = np.unique(doc[a:b], return_counts=True)
            blobs.append(pack([*listed, d, train[d], n, *_narrow(context[a:b]), *_narrow(word[a:b]), times[a:b]], _ARRAYS))
            listed = ((), ())
        return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int32()), pa.array([chunk] * len(blobs), pa.int64()),
                                           pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])

    return _chunks(unigrams, flush)


def _ask(unigrams, parts: np.ndarray, shards: int):
    """Texts to rows of one chunk and home of hashed words: the words, the
    shards that meet them and how often training texts hold them there."""

    def flush(held: list, chunk: int) -> pa.RecordBatch:
        _, train, _, doc, context, word = _pairs(held)
        far = word >= TAIL
        context, word, times = context[far], word[far], train[doc[far]].astype(np.uint32)
        shard = _shard(context, word, parts, shards)
        home = (word * U(0x9E3779B97F4A7C15) >> U(33)) % U(shards)
        order = np.lexsort((shard, word, home))
        home, word, shard, times = (x[order] for x in (home, word, shard, times))
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (shard[1:] != shard[:-1])][:len(word)])
        times = np.add.reduceat(times, first) if len(first) else times
        home, word, shard = (x[first] for x in (home, word, shard))
        cuts = np.r_[np.flatnonzero(np.r_[True, home[1:] != home[:-1]][:len(home)]), len(home)].astype(np.int64)
        blobs = [pack([word[a:b], shard[a:b], times[a:b]], _ASK) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(home[cuts[:-1]].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())],
                                          ["home", "blob"])

    return _chunks(unigrams, flush)


def _count(table: pa.Table) -> pa.Table:
    """The training counts of a home's words, one row for each shard that meets any."""
    word, shard, times = (np.concatenate(x) for x in zip(*[unpack(b.as_py(), _ASK) for b in table["blob"]], strict=True))
    distinct, place = _local(word)
    count = np.bincount(place, times, len(distinct))
    order = np.lexsort((place, shard))
    shard, place = shard[order], place[order]
    new = np.r_[True, (shard[1:] != shard[:-1]) | (place[1:] != place[:-1])] & (count[place] > 0)
    shard, place = shard[new], place[new]
    cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][:len(shard)]), len(shard)].astype(np.int64)
    blobs = [pack([distinct[place[a:b]], count[place[a:b]]], _COUNT) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([pa.array(shard[cuts[:-1]].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _chunks(unigrams, flush):
    """Texts to what ``flush`` makes of each chunk of coded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = _Coder((w, i) for i, w in enumerate(unigrams.value.words))
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list = []
        size = 0
        for batch in batches:
            for i, train, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").lower().split()
                held.append((i, train, np.fromiter(map(coder.__getitem__, words), U, len(words))))
                size += len(words) + 1
                if size >= CHUNK_PAIRS:
                    yield flush(held, chunk)
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield flush(held, chunk)

    return run


def _local(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and each row's place among them, in four bytes."""
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, place.astype(np.int32 if len(distinct) < 1 << 31 else np.int64)


class _Shard:
    """The rows of one shard as arrays; ``doc`` counts texts over all chunks."""

    def __init__(self, table: pa.Table, counted: pa.Table):
        blobs = [unpack(b.as_py(), _COUNT) for b in counted["blob"]] if counted.num_rows else [(np.empty(0, U), np.empty(0))]
        far, count = (np.concatenate(x) for x in zip(*blobs, strict=True))
        order = np.argsort(far)
        #: Hashed words that training texts hold, sorted, and their counts.
        self.far = far[order], count[order].astype(float)
        self.chunks, self.listed, self.docs = [], [], []
        train, doc, times, context, word = [], [], [], [], []
        first = 0
        for chunk, blob in zip(table["chunk"].to_pylist(), table["blob"], strict=True):
            ids, size, d, t, n, c, c_far, w, w_far, x = unpack(blob.as_py(), _ARRAYS)
            self.chunks.append((chunk, first, first + len(d)))
            self.listed.append((ids, size))
            self.docs.append(d)
            train.append(np.repeat(t.astype(bool), n))
            doc.append(np.repeat(np.arange(first, first + len(d), dtype=np.int32), n))
            times.append(x.astype(np.float32))
            context.append(_wide(c, c_far))
            word.append(_wide(w, w_far))
            first += len(d)
        self.n = first
        self.train, self.doc, self.times = (np.concatenate(x) for x in (train, doc, times))
        self.contexts, ci = _local(np.concatenate(context))
        del context
        self.words, wi = _local(np.concatenate(word))
        del word
        pair = ci.astype(U) * U(len(self.words)) + wi.astype(U)
        self.row_context = ci
        del wi
        distinct, self.pair = _local(pair)
        del pair
        self.pair_context = (distinct // U(len(self.words))).astype(np.int64)
        self.pair_word = (distinct % U(len(self.words))).astype(np.int64)

    def trie(self, unigrams: Unigrams, mu: float) -> Trie:
        """Of the pairs that training texts hold."""
        count = np.bincount(self.pair, self.times * self.train, len(self.pair_context))
        seen = np.flatnonzero(count)
        return build_trie(self.contexts[self.pair_context[seen]], self.words[self.pair_word[seen]], count[seen], unigrams, mu,
                          self.far)


def build_trie(context: np.ndarray, word: np.ndarray, count: np.ndarray, unigrams: Unigrams, mu: float,
               far: tuple[np.ndarray, np.ndarray]) -> Trie:
    """Trie of the training pairs (sorted, distinct) of a shard; ``far`` holds
    its hashed words (sorted) and their counts."""
    roots, first = np.unique(context, return_index=True)
    size = np.add.reduceat(count, first) if len(roots) else np.empty(0)
    near = roots < TAIL  # spread over shards perhaps: the corpus' counts hold
    size[near] = _top_counts(unigrams)[roots[near].astype(np.int64)]
    p1 = np.power(10.0, _log_p1(unigrams, word, far))
    total = np.repeat(size, np.diff(np.r_[first, len(context)]))
    return Trie.build(context, word, np.log10((count + mu * p1) / (total + mu)), roots, size)


def _top_counts(unigrams: Unigrams) -> np.ndarray:
    out = np.zeros(END + 1)
    out[:len(unigrams.counts)] = unigrams.counts
    out[START] = out[END] = unigrams.texts
    return out


def _log_p1(unigrams: Unigrams, word: np.ndarray, far: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    top, other, end = unigrams.log_p1()
    table = np.full(END + 1, other)
    table[:len(top)] = top
    table[END] = end
    out = np.where(word < TAIL, table[np.minimum(word, END).astype(np.int64)], other)
    hashes, count = far
    if unigrams.own and len(hashes):
        at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
        out = np.where(hashes[at] == word, other + np.log10(2 * count[at] + 1), out)  # other is that of half a count
    return out


def _score(unigrams_of, mu: float):
    """Sums per text of a chunk: log10 probability, base terms and known words
    of the pairs' contexts (every word is the context of one pair)."""

    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        unigrams, rows = unigrams_of.value, _Shard(table, counted)
        trie = rows.trie(unigrams, mu)
        parent, size = trie.contexts(rows.contexts)
        near = rows.contexts < TAIL
        size[near] = _top_counts(unigrams)[rows.contexts[near].astype(np.int64)]
        spans = tuple(x[rows.pair_context] for x in trie.spans(parent))  # two pointers a context, not a pair
        log_p = trie.log_p(parent[rows.pair_context], trie.words(rows.words)[rows.pair_word], spans)
        del spans
        miss = np.flatnonzero(np.isnan(log_p))
        log_p[miss] = _log_p1(unigrams, rows.words, rows.far)[rows.pair_word[miss]] + np.log10(mu / (size[rows.pair_context[miss]] + mu))
        del trie, miss
        total = np.bincount(rows.doc, rows.times * log_p[rows.pair], rows.n)
        word = rows.contexts != U(START)
        base = np.bincount(rows.doc, rows.times * (word * unigrams.base(size))[rows.row_context], rows.n)
        known = np.bincount(rows.doc, rows.times * (word & (size > 0))[rows.row_context], rows.n)
        out: dict = {"chunk": [], "ids": [], "sizes": [], "sums": []}
        for (chunk, a, b), (ids, sizes), d in zip(rows.chunks, rows.listed, rows.docs, strict=True):
            out["chunk"].append(chunk)
            out["ids"].append(ids.tobytes())
            out["sizes"].append(sizes.tobytes())
            out["sums"].append(pack([d, total[a:b], base[a:b], np.rint(known[a:b])], _SUMS))
        return pa.table([pa.array(out["chunk"], pa.int64()), *[pa.array(out[k], pa.binary()) for k in ("ids", "sizes", "sums")]],
                        names=list(out))

    return run


def _combine(table: pa.Table) -> pa.Table:
    """The texts of one chunk with their sums over all shards."""
    ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table["ids"]])
    sizes = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["sizes"]])
    sums = [np.zeros(len(ids)) for _ in range(3)]
    for blob in table["sums"]:
        d, *parts = unpack(blob.as_py(), _SUMS)
        for total, part in zip(sums, parts, strict=True):
            total[d] += part
    return pa.table([pa.array(ids), pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                     pa.array(np.rint(sums[2]).astype(np.int64))], names=["id", "n_tokens", "log_p", "base", "known"])


def _tries(unigrams_of, mu: float):
    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        trie = _Shard(table, counted).trie(unigrams_of.value, mu)
        return pa.table([pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([trie.children.n], pa.int64()),
                         pa.array([trie.tobytes()], pa.binary())], names=["shard", "pairs", "trie"])

    return run


class NgramModel:
    """Counts the training rows at once; ``is_train`` is a condition on the
    columns of ``docs``.  ``pairs_per_shard`` bounds what a task holds,
    ``code_words`` the words that every task knows."""

    def __init__(self, docs: DataFrame, is_train: Column, doc_id: str = "doc_id", text: str = "text",
                 top_words: int | None = None, mu: float = 256.0, pairs_per_shard: int = 2_000_000,
                 code_words: int = 60_000):
        own = top_words is None
        top_words = code_words if own else top_words
        if top_words > START:
            raise ValueError(f"at most {START} top words")
        d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                        F.coalesce(is_train, F.lit(False)).cast("int").alias("train"), text_of(text).alias("text"))
        self.docs = d.select("id", "train", "text")
        self.mu = mu
        self.unigrams = count_words(d.where("train = 1").select("text"), top_words, own)
        share = d.agg(F.sum("train").alias("t"), F.count(F.lit(1)).alias("n")).first()
        pairs = (self.unigrams.tokens + 1) * max(1.0, (share["n"] or 0) / max(1, share["t"] or 0))
        self.shards = max(1, math.ceil(pairs / pairs_per_shard))
        counts = _top_counts(self.unigrams)
        self.parts = np.maximum(1, np.ceil(counts / (pairs_per_shard / 4))).astype(np.int64)

    def _dealt(self):
        """The pairs and the counts of hashed words, grouped by shard."""
        u = self.unigrams
        shared = self.docs.sparkSession.sparkContext.broadcast(u)  # top_words words and counts
        dealt = map_texts(self.docs, _deal(shared, self.parts, self.shards), _DEALT)
        if u.own and u.types - (u.texts > 0) > len(u.words):
            counted = map_texts(self.docs, _ask(shared, self.parts, self.shards), _ASKED).groupBy("home").applyInArrow(_count, _COUNTED)
        else:
            counted = self.docs.sparkSession.createDataFrame([], _COUNTED)
        return dealt.groupBy("shard").cogroup(counted.groupBy("shard")), shared

    def tries(self) -> DataFrame:
        """The model: ``shard, pairs, trie``, one memory-mappable trie per shard."""
        dealt, shared = self._dealt()
        return dealt.applyInArrow(_tries(shared, self.mu), "shard int, pairs bigint, trie binary")

    def score(self) -> DataFrame:
        """Per row of the documents: ``doc_id, n_tokens, n_known, train_tokens,
        base_score, score``.

        A null or empty text is the end alone.  Rows that share an id are scored
        one by one, repeated rows alike; null ids stay null.  Without training
        rows every count is zero and the probabilities are those of add-half.
        Empty tables give an empty result."""
        dealt, shared = self._dealt()
        sums = dealt.applyInArrow(_score(shared, self.mu), "chunk bigint, ids binary, sizes binary, sums binary")
        out = sums.groupBy("chunk").applyInArrow(
            _combine, "id bigint, n_tokens bigint, log_p double, base double, known bigint")
        u = self.unigrams
        return out.select(
            F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_tokens",
            (F.col("known") + int(u.texts > 0)).alias("n_known"), F.lit(u.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + float(u.base(u.texts)) - F.col("n_tokens") * u.base_total).alias("base_score"),
            F.col("log_p").alias("score"))
