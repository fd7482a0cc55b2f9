"""A hierarchical index of fingerprints in Gray order, for Hamming search.

Fingerprints are sorted by Gray rank (their position when they are read as Gray code), which puts those that share leading bits, and
differ little after them, side by side. A node of the index stands for a run of the sorted list. It holds every bit on which all
of its members agree and that no node above it holds yet: a mask and a pattern. A search goes down level by level with the number
of differences so far; a whole group is dropped as soon as that number is over the radius. All of a level is done at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ONE = np.uint64(1)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The rank of each 64-bit word in the reflected Gray code."""
    out = values.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """values: distinct 64-bit fingerprints. member[i] is the place in values of the i-th in Gray order."""

    def __init__(self, values: np.ndarray, step: int = 4):
        values = values.astype(np.uint64)
        rank = gray_rank(values)
        self.member = np.argsort(rank, kind="stable")
        ordered, rank = values[self.member], rank[self.member]
        n = len(ordered)
        starts = [np.zeros(min(n, 1), dtype=np.int64)]
        for depth in range(step, 64, step):
            top = rank >> np.uint64(64 - depth)
            now = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1]).astype(np.int64) if n else starts[0]
            if len(now) > len(starts[-1]):
                starts.append(now)
            if len(now) * 3 >= n:
                break
        if len(starts[-1]) < n:
            starts.append(np.arange(n, dtype=np.int64))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child, last child + 1
        above = np.zeros(1, dtype=np.uint64)
        for k, now in enumerate(starts):
            if not n:
                break
            every = np.bitwise_and.reduceat(ordered, now)
            some = np.bitwise_or.reduceat(ordered, now)
            shared = ~(every ^ some)
            if k:
                parent = np.searchsorted(starts[k - 1], now, side="right") - 1
                above = held[parent]
            mask = shared & ~above
            held = shared
            below = starts[k + 1] if k + 1 < len(starts) else None
            first = np.searchsorted(below, now) if below is not None else now
            last = np.append(first[1:], len(below) if below is not None else n)
            self.levels.append((mask, every & mask, first, last))

    def search(self, queries: np.ndarray, radius: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in queries, place in values) of all within the radius, block by block of queries."""
        queries = queries.astype(np.uint64)
        for at in range(0, len(queries), block):
            yield from self._down(queries, np.arange(at, min(at + block, len(queries))), radius)

    def _down(self, queries: np.ndarray, q: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.levels:
            return
        node, spent = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        for k, (mask, pattern, first, last) in enumerate(self.levels):
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            near = spent <= radius
            q, node, spent = q[near], node[near], spent[near]
            if k + 1 < len(self.levels):
                n = last[node] - first[node]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, spent, node = np.repeat(q, n), np.repeat(spent, n), np.repeat(first[node], n) + within
        yield q, self.member[node]
