"""Hierarchical index over binary codes in Gray order.

Codes are sorted by their rank in the reflected Gray sequence, where neighbours
differ in few bits, and cut into windows.  A node keeps the bits on which all
codes below it agree; bits that its parent already fixes are factored out, so
each bit is compared once on the way down.  A search adds up the differences
met so far and drops a whole node as soon as they exceed the radius.

The arrays hold many groups of codes at once (one root each); a search compares
a code only with codes of its own group.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

LEAF = 16
FANOUT = 8
#: Pairs of query and node held at a time.
FRONTIER = 1 << 20


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


def _runs(group: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows of up to ``width`` rows that never straddle a group."""
    n = len(group)
    first = np.r_[True, group[1:] != group[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return np.flatnonzero((np.arange(n) - begin) % width == 0)


class GrayIndex:
    """``codes`` (uint64) and ``group`` must be sorted by (group, Gray rank)."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.codes, self.group = codes, group
        starts = _runs(group, leaf)
        g = group[starts]
        every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        # from the leaves up: first child (and one past the last), first code, fixed bits, pattern
        self.levels = [{"kids": np.r_[starts, len(codes)], "end": np.r_[starts[1:], len(codes)],
                        "fixed": ~(every ^ some), "pattern": every}]
        while len(g) > 1 and (g[1:] == g[:-1]).any():
            starts = _runs(g, fanout)
            end = self.levels[-1]["end"][np.r_[starts[1:], len(g)] - 1]
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            self.levels.append({"kids": np.r_[starts, len(g)], "end": end, "fixed": ~(every ^ some), "pattern": every})
            g = g[starts]
        for lower, upper in zip(self.levels, self.levels[1:], strict=False):
            parent = np.repeat(np.arange(len(upper["end"])), np.diff(upper["kids"]))
            lower["own"] = lower["fixed"] & ~upper["fixed"][parent]
        self.levels[-1]["own"] = self.levels[-1]["fixed"]
        self.root_of = np.searchsorted(g, group) if len(g) else np.empty(0, np.int64)
        self.width = int(np.bincount(self.root_of).max()) if len(codes) else 0

    def pairs(self, queries: np.ndarray, radius: int):
        """Yield arrays (i, j), i < j, of positions in the same group whose codes
        differ in at most ``radius`` bits; i runs over ``queries``."""
        block = max(1, FRONTIER // max(1, self.width))
        for at in range(0, len(queries), block):
            yield self._search(queries[at:at + block], radius)

    def _search(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        node, acc = self.root_of[q], np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            acc = acc + np.bitwise_count((self.codes[q] ^ level["pattern"][node]) & level["own"][node])
            stay = (acc <= radius) & (level["end"][node] > q + 1)  # only later codes are wanted
            q, node, acc = q[stay], node[stay], acc[stay]
            first = level["kids"][node]
            n = level["kids"][node + 1] - first
            rest = ~level["fixed"][node]
            child = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            q, acc, rest, node = np.repeat(q, n), np.repeat(acc, n), np.repeat(rest, n), child
        near = (node > q) & (acc + np.bitwise_count((self.codes[q] ^ self.codes[node]) & rest) <= radius)
        return q[near], node[near]

    def roots(self, radius: int) -> np.ndarray:
        """For each position the smallest position linked to it, directly or not."""
        root = np.arange(len(self.codes))
        for i, j in self.pairs(np.arange(len(self.codes)), radius):
            while True:
                a, b = root[i], root[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root != root[root]).any():
                    root = root[root]
        return root
