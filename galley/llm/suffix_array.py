"""Blockwise suffix sorting with a difference cover.

Positions whose remainder modulo PERIOD lies in COVER are ranked first, by doubling. For any two positions there is a small
shift that takes both into the cover, so suffixes that agree in their first bytes are ordered by the ranks at that shift. The
suffixes asked for are then sorted one bucket of first bytes at a time: beyond the text and the cover's ranks, memory is
bounded by a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD = 7
COVER = (0, 1, 3)
BUCKET = 200_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: The least shift that takes both remainders into the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


class BlockSuffixes:
    """Orders suffixes of ``body`` by at least their first ``depth`` bytes; none asked for may be shorter than that."""

    def __init__(self, body: np.ndarray, depth: int):
        self.n, self.depth = len(body), depth
        padded = np.concatenate([body, np.zeros(PERIOD, np.uint8)])
        self.head = np.zeros(self.n, np.uint64)
        for k in range(PERIOD):
            self.head = (self.head << np.uint64(8)) | padded[k : k + self.n]
        self.rank = self._cover_ranks()

    def _cover_ranks(self) -> np.ndarray:
        """Rank, from 1, of each cover position by its first ``depth`` bytes or more; 0 elsewhere and past the end."""
        at = np.flatnonzero(_IN_COVER[np.arange(self.n) % PERIOD])
        rank = np.zeros(self.n + 1, np.uint32)
        key, reach = self.head[at], PERIOD
        while len(at):
            order = np.argsort(key)
            ranked = key[order]
            dense = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            rank[at[order]] = dense
            if reach >= self.depth or dense[-1] == len(at):
                break
            key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + reach, self.n)]
            reach *= 2
        return rank

    def buckets(self, wanted: np.ndarray) -> Iterator[np.ndarray]:
        """The wanted positions in suffix order, a bucket at a time; equal heads share a bucket."""
        heads = self.head[wanted]
        count = max(1, len(wanted) // BUCKET)
        step = max(1, len(heads) // (64 * count))
        sample = np.sort(heads[::step])
        splitters = np.unique(sample[np.linspace(0, len(sample) - 1, count + 1).astype(int)[1:-1]]) if len(sample) else sample
        number = np.searchsorted(splitters, heads, "left").astype(np.uint16 if count < 65_536 else np.int64)
        order = np.argsort(number, kind="stable")
        borders = np.searchsorted(number[order], np.arange(len(splitters) + 2))
        for a, b in zip(borders[:-1], borders[1:]):
            if b > a:
                yield self._sorted(wanted[order[a:b]])

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        at = at[np.argsort(self.head[at])]
        heads = self.head[at]
        group = np.cumsum(np.concatenate([[True], heads[1:] != heads[:-1]])) - 1
        tied = np.bincount(group)[group] > 1
        if not tied.any():
            return at
        # Order inside each group of equal heads: for each remainder by its own ranks, across remainders by counting.
        place = np.zeros(len(at), np.int64)
        remainder = at % PERIOD
        members: list[np.ndarray] = []
        for r in range(PERIOD):
            mine = np.flatnonzero(tied & (remainder == r))
            members.append(mine[np.argsort(self._key(group, at, mine, r, r))])
        for r, mine in enumerate(members):
            place[mine] += np.arange(len(mine)) - np.searchsorted(group[mine], group[mine])
            for other, theirs in enumerate(members):
                if other != r and len(mine) and len(theirs):
                    keys = np.maximum.accumulate(self._key(group, at, theirs, other, r))
                    before = np.searchsorted(keys, self._key(group, at, mine, r, other), "right" if other < r else "left")
                    place[mine] += before - np.searchsorted(group[theirs], group[mine])
        return at[np.lexsort((place, group))]

    def _key(self, group: np.ndarray, at: np.ndarray, members: np.ndarray, own: int, other: int) -> np.ndarray:
        return (group[members].astype(np.uint64) << np.uint64(32)) | self.rank[np.minimum(at[members] + _SHIFT[own, other], self.n)]

    def equal_to_next(self, at: np.ndarray) -> np.ndarray:
        """For neighbours in ``at``: are their first ``depth`` bytes equal? Compared directly, some bytes at a time."""
        same = np.arange(len(at) - 1)
        steps = [*range(0, self.depth - PERIOD, PERIOD), self.depth - PERIOD]
        for k in steps:
            same = same[self.head[at[same] + k] == self.head[at[same + 1] + k]]
        out = np.zeros(max(0, len(at) - 1), bool)
        out[same] = True
        return out
