"""Elias-Fano sequences and an n-gram trie made of them, in flat memory maps.

A non-decreasing sequence keeps the low bits of its values packed and the high
bits in unary, about two bits a value more than the information itself.  A trie
level is three such sequences: the children's ids made monotone by their
parent's place (``parent * width + id``), the pointers to each parent's first
child, and nothing else; payloads are quantised.  A lookup is a successor search
relative to the context: the smallest stored key not below the wanted one.

All searches take arrays of keys.  A trie is one buffer: it can be written to a
file and memory-mapped again.
"""

from __future__ import annotations

import mmap
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

U = np.uint64


class EliasFano:
    """``values``: non-decreasing uint64."""

    def __init__(self, values: np.ndarray):
        v = values.astype(U)
        self.n = len(v)
        top = int(v[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = v >> U(self.low_bits)
        self.n_high = int(high[-1]) + 1 if self.n else 0
        bits = np.zeros(-(-(self.n + self.n_high + 1) // 64) * 8, np.uint8)
        place = high + np.arange(self.n, dtype=U)
        flags = np.zeros(len(bits) * 8, bool)
        flags[place.astype(np.int64)] = True
        self.high = np.packbits(flags, bitorder="little").view(U)
        self.low = _pack(v & U((1 << self.low_bits) - 1), self.low_bits)
        self._count()

    def _count(self) -> None:
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def _select(self, k: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) set bit of ``words``; ``before``: set bits up to each word."""
        w = np.searchsorted(before, k, side="right") - 1
        rest, word, at = k - before[w], words[w], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & U((1 << half) - 1)).astype(np.int64)
            up = rest >= c
            rest = np.where(up, rest - c, rest)
            at += np.where(up, half, 0)
            word = np.where(up, word >> U(half), word)
        return w * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, self.high) - i
        return high.astype(U) << U(self.low_bits) | _unpack(self.low, self.low_bits, i)

    def successor(self, x: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Index of the first value not below x (n if there is none).  ``within``:
        first index and end of the range of each x, its end if all values there are below."""
        x = x.astype(U)
        h = x >> U(self.low_bits)
        out = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(h < U(self.n_high))
        h, low = h[inside].astype(np.int64), x[inside] & U((1 << self.low_bits) - 1)
        zeros = ~self.high
        end = self._select(h, self.zeros, zeros) - h
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, zeros) + 1 - h, 0)
        if within is not None:
            least, most = (w.astype(np.int64) for w in within)
            out = np.minimum(out, most)
            begin, end = (np.clip(i, least[inside], most[inside]) for i in (begin, end))
        while True:  # all searches halve their ranges together
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                break
            mid = (begin[open_] + end[open_]) // 2
            less = _unpack(self.low, self.low_bits, mid) < low[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
        out[inside] = begin
        return out

    def find(self, x: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether the value is there) of each x, in its range if ranges are given; strictly rising values."""
        i = self.successor(x, within)
        there = i < (self.n if within is None else within[1])
        there[there] = self.get(i[there]) == x[there].astype(U)
        return i, there

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, self.n_high, len(self.high), len(self.low)], U), self.high, self.low]

    @classmethod
    def read(cls, words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        self = cls.__new__(cls)
        self.n, self.low_bits, self.n_high, a, b = (int(x) for x in words[at:at + 5])
        at += 5
        self.high, self.low = words[at:at + a], words[at + a:at + a + b]
        self._count()
        return self, at + a + b


def _pack(v: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(v) * bits // 64 + 2, U)
    if bits:
        place = np.arange(len(v), dtype=np.int64) * bits
        word, shift = place >> 6, (place & 63).astype(U)
        np.bitwise_or.at(out, word, v << shift)
        over = np.flatnonzero((place & 63) + bits > 64)
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


def _unpack(packed: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), U)
    place = i * bits
    word, shift = place >> 6, (place & 63).astype(U)
    high = np.where(shift > 0, packed[word + 1] << (U(63) - shift) << U(1), U(0))
    return (packed[word] >> shift | high) & U((1 << bits) - 1)


def quantise(x: np.ndarray, bits: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Codes and codebook: bins of equal width, so that no value is off by more
    than the width, each standing for the mean of its values."""
    if not len(x):
        return np.empty(0, np.uint16), np.zeros(1)
    low, width = float(x.min()), float(np.ptp(x)) / ((1 << bits) - 1) or 1.0
    code = ((x - low) / width).astype(np.uint16)
    used, code = np.unique(code, return_inverse=True)
    return code.astype(np.uint16), np.bincount(code, x, len(used)) / np.bincount(code, minlength=len(used))


class Trie:
    """Two-level trie of (context, word) with a quantised log10 probability per
    pair and an exact count per context.  Codes are uint64."""

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, roots: np.ndarray,
              counts: np.ndarray) -> Trie:
        """Pairs sorted by (context, word); ``roots``: sorted distinct contexts with ``counts``."""
        vocabulary = np.unique(word)
        parent = np.searchsorted(roots, context)
        key = parent.astype(U) * U(max(1, len(vocabulary))) + np.searchsorted(vocabulary, word).astype(U)
        pointers = np.searchsorted(parent, np.arange(len(roots) + 1)).astype(U)
        code, book = quantise(log_p)
        padded = np.zeros(-(-len(code) // 4) * 4, np.uint16)
        padded[:len(code)] = code
        parts = [np.array([len(code), len(book)], U), padded.view(U), book.view(U)]
        for values in (roots, np.cumsum(np.concatenate([[0], counts])).astype(U), vocabulary, pointers, key):
            parts += EliasFano(values).parts()
        flat = np.concatenate(parts)
        # the levels live in one memory map, outside the interpreter's heap
        buffer = mmap.mmap(-1, max(8, flat.nbytes))
        buffer[:flat.nbytes] = flat.tobytes()
        return cls(buffer, flat.nbytes)

    def __init__(self, buffer, size: int | None = None):
        self.buffer, self.size = buffer, len(buffer) if size is None else size
        words = np.frombuffer(buffer, U, self.size // 8)
        n, b = int(words[0]), int(words[1])
        at = 2 + -(-n // 4)
        self.code = words[2:at].view(np.uint16)[:n]
        self.book = words[at:at + b].view(np.float64)
        at += b
        levels = []
        for _ in range(5):
            level, at = EliasFano.read(words, at)
            levels.append(level)
        self.roots, self.totals, self.vocabulary, self.pointers, self.children = levels

    def contexts(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, count) of contexts; count 0 where a context is unknown."""
        i, there = self.roots.find(context)
        count = np.zeros(len(context))
        count[there] = (self.totals.get(i[there] + 1) - self.totals.get(i[there])).astype(float)
        return np.where(there, i, -1), count

    def words(self, word: np.ndarray) -> np.ndarray:
        """Ids of words, -1 where unknown."""
        i, there = self.vocabulary.find(word)
        return np.where(there, i, -1)

    def spans(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and end of the children of contexts by their index, from the pointers; empty where unknown."""
        begin, end = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        known = np.flatnonzero(parent >= 0)
        begin[known], end[known] = (self.pointers.get(parent[known] + k).astype(np.int64) for k in (0, 1))
        return begin, end

    def log_p(self, parent: np.ndarray, word: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Stored log10 probability by context index and word id; NaN where the
        pair is unknown.  The search runs between the context's pointers
        (``spans`` of the parents, if they are known already)."""
        out = np.full(len(parent), np.nan)
        begin, end = self.spans(parent) if spans is None else spans
        ask = np.flatnonzero((begin < end) & (word >= 0))
        i, there = self.children.find(parent[ask].astype(U) * U(max(1, self.vocabulary.n)) + word[ask].astype(U),
                                      (begin[ask], end[ask]))
        out[ask[there]] = self.book[self.code[i[there]]]
        return out

    def tobytes(self) -> bytes:
        return bytes(self.buffer[:self.size])
