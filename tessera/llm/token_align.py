"""Alignment of two tokenizers by pointer jumping, and corpus-wide counts of the
ids that stand for the same bytes.

Both tokenizers cut the same bytes (a space, then the text).  Tokens that share
a byte belong together, and so do all that are connected through such tokens: a
*group* ends where a token of each ends.  Every token points to the token of the
other side that holds its last byte, if that reaches farther right; else it
points to itself (of two that end together, B's points to A's).  Replacing every
pointer by its pointer's pointer doubles the distance it spans, so after
logarithmically many vectorised rounds each token points to the terminal token
of its component, which labels the group.

Texts are aligned by *units*: cut before a space that follows a printable ASCII
character, where both tokenizers always end a token.  A chunk of texts has far
fewer different units than units, so units are tokenised and aligned once per
chunk, all in the same arrays, and a text's figures are gathered from its units'.

An id pair's count is the number of documents that link it.  Each chunk adds up
its documents first and sends one row per distinct pair; the counts come back
to the chunk's documents the same way, so a pair that stands in every document
travels once per chunk.  No step needs all pairs in one place.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, stage, text_of
from tessera.llm.packing import encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

CHUNK_BYTES = 1 << 22
#: Characters that are tokenised in one call.
RUN_CHARS = 1 << 12
#: Links of one group expanded at a time.
BLOCK = 1 << 20
UNIT_END = re.compile(r"(?<=[!-~])(?= )")
SPACE_MARK = "▁"
_PIECES: dict = {}


class Pieces:
    """A sentencepiece vocabulary: ids of a unit, bytes of an id."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                      for i, p in enumerate(names)]
        # pieces cross no unit end if none holds a space behind another character
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names):
            raise ValueError("the model has pieces that cross word ends")
        # a lone space as the model codes it behind a word
        self.blank = self.model.encode("a ")[len(self.model.encode("a")):]

    def encode(self, units: Sequence[str]) -> list[list[int]]:
        """Ids of units, each of which begins with the space that the model adds."""
        found = self.model.encode([u[1:] for u in units], num_threads=1)
        return [ids if len(u) > 1 else self.blank for u, ids in zip(units, found, strict=True)]


def pieces(model: str) -> Pieces:
    if model not in _PIECES:
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def byte_lengths(vocabulary: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary, one character standing for each."""
    key = ("lengths", vocabulary)
    if key not in _PIECES:
        import json

        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        out[list(vocab.values())] = [len(w) for w in vocab]
        _PIECES[key] = out
    return _PIECES[key]


def units_of(text: str) -> list[str]:
    """A space and the text, cut into units."""
    return UNIT_END.split(" " + text)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def terminal(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 on, of the tokens of A and B, given where they end."""
    n = len(end_a)
    over_a = np.searchsorted(end_b, end_a, "left")  # the token of B that holds the last byte of a token of A
    over_b = np.searchsorted(end_a, end_b, "left")
    pointer = np.concatenate([np.where(end_b[over_a] > end_a, n + over_a, np.arange(n)), over_b])
    while True:
        jumped = pointer[pointer]
        if np.array_equal(jumped, pointer):
            break
        pointer = jumped
    last = pointer[:n] == np.arange(n)  # terminal tokens are A's
    number = np.cumsum(last) - 1
    return number[pointer[:n]], number[pointer[n:]]


class Coder:
    """Both tokenizers over units, many at a time: units that end in a printable
    ASCII character are coded in one string and told apart by where tokens end;
    others, and runs whose bytes do not come out right, one by one."""

    def __init__(self, vocabulary: str, model: str):
        self.encode, self.b_side = encoder(vocabulary), pieces(model)
        self.a_length = byte_lengths(vocabulary)
        self.b_length = np.array([len(x) for x in self.b_side.bytes], np.int64)

    def code(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many each unit has, the same of B, and which units fit:
        their bytes come out of both.  Others have no ids."""
        runs: list[list[str]] = []
        size = RUN_CHARS
        for u in units:
            alone = not "!" <= u[-1] <= "~"
            if alone or size >= RUN_CHARS:
                runs.append([])
                size = 0
            runs[-1].append(u)
            size += RUN_CHARS if alone else len(u)
        parts = [part for r in runs for part in self._run(r)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _run(self, units: list[str]):
        data = [u.encode("utf-8", "surrogatepass") for u in units]
        whole = b"".join(data)
        ends = np.cumsum([len(d) for d in data])
        a = self.encode("".join(units)).astype(np.int64)
        b = np.array(self.b_side.encode(["".join(units)])[0], np.int64)
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        if len(end_a) and len(end_b) and end_a[-1] == len(whole) == end_b[-1] and (end_a[at_a] == ends).all() \
                and (end_b[at_b] == ends).all() and b"".join([self.b_side.bytes[i] for i in b.tolist()]) == whole:
            yield a, np.diff(at_a + 1, prepend=0), b, np.diff(at_b + 1, prepend=0), np.ones(len(units), bool)
        elif len(units) == 1:
            none = np.empty(0, np.int64)
            yield none, np.zeros(1, np.int64), none, np.zeros(1, np.int64), np.zeros(1, bool)
        else:
            half = len(units) // 2
            yield from self._run(units[:half])
            yield from self._run(units[half:])


class Units:
    """Distinct units of a chunk, tokenised and aligned together."""

    def __init__(self, units: list[str], coder: Coder):
        # the bytes of units that fit, laid end to end
        a, self.n_a, b, self.n_b, self.fits = coder.code(units) if units else (np.empty(0, np.int64),) * 5
        a_length, b_length = coder.a_length, coder.b_length
        group_a, group_b = terminal(np.cumsum(a_length[a]), np.cumsum(b_length[b]))
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        unit_of_a = np.repeat(np.arange(len(units)), self.n_a)
        unit_of_group = unit_of_a[np.cumsum(in_a) - 1] if groups else np.empty(0, np.int64)
        self.n_groups = np.bincount(unit_of_group, minlength=len(units))
        self.n_links = np.bincount(unit_of_group, weights=(in_a * in_b).astype(float), minlength=len(units)).astype(np.int64)
        self.text = self._written(a, b, group_a, group_b, in_a, in_b)
        self.pairs, self.first, self.pair_at, self.pair_times = self._pairs(a, b, in_a, in_b, unit_of_group, len(units))

    def _written(self, a, b, group_a, group_b, in_a, in_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of every unit."""
        if not len(a):
            return [b""] * len(self.n_a)
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        words = np.empty(len(a) + len(b), object)
        words[at_a] = [b"%d|" % i if z else b"%d," % i for i, z in zip(a.tolist(), last_a.tolist(), strict=True)]
        words[at_b] = [b"%d;" % i if z else b"%d," % i for i, z in zip(b.tolist(), last_b.tolist(), strict=True)]
        words, ends = words.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(words[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _pairs(a, b, in_a, in_b, unit_of_group, n_units):
        """Distinct linked pairs (``a << 32 | b``) and, per unit, which of them it
        links how often."""
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        found, weight, unit = [], [], []
        links = in_a * in_b
        plain = links <= BLOCK
        part = np.cumsum(np.where(plain, links, 0)) // BLOCK
        for k in np.unique(part[plain]) if len(part) else []:
            g = np.flatnonzero(plain & (part == k))
            each_a = ragged(from_a[g], in_a[g])
            width = np.repeat(in_b[g], in_a[g])
            right = b[ragged(np.repeat(from_b[g], in_a[g]), width)]
            found.append(np.repeat(a[each_a], width) << 32 | right)
            unit.append(np.repeat(unit_of_group[g], links[g]))
            weight.append(np.ones(len(right), np.int64))
        for g in np.flatnonzero(~plain):  # by distinct ids of both sides, in blocks
            left, many = np.unique(a[from_a[g]:from_a[g] + in_a[g]], return_counts=True)
            right, times = np.unique(b[from_b[g]:from_b[g] + in_b[g]], return_counts=True)
            for rows in np.array_split(np.arange(len(left)), max(1, len(left) * len(right) // BLOCK)):
                found.append((left[rows, None] << 32 | right[None, :]).ravel())
                weight.append((many[rows, None] * times[None, :]).ravel())
                unit.append(np.full(len(rows) * len(right), unit_of_group[g]))
        if not found:
            return np.empty(0, np.int64), np.zeros(n_units + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        pairs, at = np.unique(np.concatenate(found), return_inverse=True)
        key, times = _added(np.concatenate(unit) * len(pairs) + at, np.concatenate(weight))
        first = np.searchsorted(key, np.arange(n_units + 1) * len(pairs))
        return pairs, first, key % len(pairs), times


def _added(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their weights."""
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(weight, first) if len(first) else weight


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
CHUNK_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
               "at binary, times binary, pairs array<long>, held array<long>"


def _aligner(vocabulary: str, model: str, chunk_bytes: int, with_groups: bool):
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["chunk", "doc_id", *FIGURES, "groups_sha256", "at", "times", "pairs", "held"]
    if with_groups:
        kinds, names = [*kinds, pa.string()], [*names, "groups"]

    def of_chunk(chunk: int, coder: Coder, ids: list, docs: list[list[str]]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        seq = [np.fromiter((number.setdefault(u, len(number)) for u in d), np.int64, len(d)) for d in docs]
        units = Units(list(number), coder)
        rows = []
        bounds = np.cumsum([0, *map(len, seq)])
        every = np.concatenate(seq) if seq else np.empty(0, np.int64)
        whole = np.array([len(s) > 0 and bool(units.fits[s].all()) for s in seq], bool)
        doc = np.repeat(np.arange(len(seq)), np.diff(bounds))
        inside = whole[doc]
        # what each document links, by way of its distinct units
        key, often = _added(doc[inside] * max(1, len(number)) + every[inside], np.ones(int(inside.sum()), np.int64))
        doc_of, unit = np.divmod(key, max(1, len(number)))
        many = units.first[unit + 1] - units.first[unit]
        at = ragged(units.first[unit], many)
        width = max(1, len(units.pairs))
        key, times = _added(np.repeat(doc_of, many) * width + units.pair_at[at], np.repeat(often, many) * units.pair_times[at])
        doc_of, pair = np.divmod(key, width)
        cut = np.searchsorted(doc_of, np.arange(len(seq) + 1))
        for k, s in enumerate(seq):
            written = b"".join([units.text[u] for u in s.tolist()])[:-1] if whole[k] else b""
            figures = [int(getattr(units, f)[s].sum()) for f in FIGURES] if whole[k] else [0] * 4
            here = slice(cut[k], cut[k + 1])
            rows.append((chunk, ids[k], *figures, hashlib.sha256(written).hexdigest() if whole[k] else "",
                         pair[here].astype(np.int32).tobytes(), times[here].astype(np.int32).tobytes()
                         if not len(times) or times.max() < 1 << 31 else times[here].tobytes(), None, None,
                         *[written.decode()] * with_groups))
        held = np.bincount(pair, minlength=len(units.pairs))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
        one = [[chunk], *[[None]] * 8, [units.pairs], [held], *[[None]] * with_groups]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partitions of a scan are the same when a task runs again, and so are these numbers
        chunk = TaskContext.get().partitionId() << 32
        coder = Coder(vocabulary, model)
        ids: list = []
        docs: list = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc)
                docs.append(units_of(text) if text else [])
                size += len(text)
                if size >= chunk_bytes:
                    yield from of_chunk(chunk, coder, ids, docs)
                    chunk, ids, docs, size = chunk + 1, [], [], 0
        if ids:
            yield from of_chunk(chunk, coder, ids, docs)

    return run


def _finish(with_groups: bool):
    names = ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        pair, n, best = (counts.column(k).to_numpy() for k in ("pair", "n", "best"))
        order = np.argsort(pair)
        n, best = n[order], best[order].astype(np.int64)
        n_best, total = [], []
        for at, times in zip(docs.column("at"), docs.column("times"), strict=True):
            at, raw = np.frombuffer(at.as_py(), np.int32), times.as_py()
            times = np.frombuffer(raw, np.int32 if len(raw) == 4 * len(at) else np.int64).astype(np.int64)
            n_best.append(int((times * best[at]).sum()))
            total.append(int((times * n[at]).sum()))
        cols = {k: docs.column(k) for k in names if k in docs.column_names}
        cols |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({k: cols[k] for k in names})

    return run


def align(docs: DataFrame, vocabulary: str, model: str, doc_id: str = "doc_id", text: str = "text",
          chunk_bytes: int = CHUNK_BYTES, with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256`` and, ``with_groups``, the groups as text.

    ``vocabulary`` is the JSON file of a byte-level BPE (A), ``model`` a
    sentencepiece BPE (B) that puts a space before the text.  Links are the pairs
    of tokens of A and B that share a group; the count of an id pair is the number
    of rows that link it, ``n_best`` the links whose count is the highest of their
    A id's (ties included), ``count_sum`` the sum over links.  Rows are counted as
    documents of their own, whether or not they share an id.  A null or empty
    text, and one whose bytes a tokenizer changes, has no tokens: zeros and an
    empty digest.  An empty table gives an empty result."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    schema = CHUNK_SCHEMA + ", groups string" * with_groups
    chunks = stage(map_texts(d, _aligner(vocabulary, model, chunk_bytes, with_groups), schema), "aligned")
    asked = chunks.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("p")) \
        .select("chunk", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = stage(asked.groupBy("pair").agg(F.sum("held").alias("n")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    # one row per id of A: no more than the vocabulary has
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(highest), a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select(F.col("chunk").alias("_chunk"), "pair").join(counts, "pair")
    rows = chunks.where("pairs IS NULL").drop("pairs", "held")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        _finish(with_groups), out + ", groups string" * with_groups)
