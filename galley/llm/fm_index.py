"""A compressed full-text index over words: the Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Suffixes are sorted to a depth that no pattern exceeds; that orders every pattern's occurrences together, which is all that
backward search needs. Searches of many patterns advance together, one word a step.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers ordered by their first ``depth`` symbols, by doubling; symbols are non-negative, 0 ends a piece."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    per = max(1, 62 // (bits + 1))
    key = np.zeros(n, np.uint64)
    for k in range(per):
        key <<= np.uint64(bits)
        key[: n - k] |= text[k:].astype(np.uint64)
    reach = per
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])).astype(np.uint64)
        if reach >= depth or n == 0 or int(rank[order[-1]]) == n:
            return order
        key = rank << np.uint64(32)
        key[: max(0, n - reach)] |= rank[reach:]
        reach *= 2


class Wavelet:
    """Symbol counts in any prefix of a sequence: one packed bit vector per bit of a symbol, with counts at 64-bit borders."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` leads for each symbol: the symbol's first place at the bottom plus its count before ``at``."""
        for k in range(self.bits):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Index of a text of symbols (0 ends a piece); patterns may be up to ``depth`` symbols long."""

    def __init__(self, text: np.ndarray, depth: int):
        order = sorted_suffixes(text, depth)
        top = int(text.max()) if len(text) else 0
        self.n = len(text)
        self.wavelet = Wavelet(text[order - 1], max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        symbols = np.arange(top + 1)
        self.shift = self.first[:-1] - self.wavelet.descend(symbols, np.zeros(top + 1, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from the intervals of patterns."""
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        move = self.shift[symbol]
        return both[: len(symbol)] + move, both[len(symbol) :] + move

    def repeated(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(stream, position) of each window of ``size`` symbols that the index holds at least twice.

        The streams text[start:end] are read from their ends. A stream's match is kept as long as possible: it grows to the left
        while it occurs twice, which gives the matching statistic of its end; where it is at least ``size`` long, the window
        at its left end is reported. Where it cannot grow, all windows that hold the failing match are ruled out at once.
        """
        stream = np.flatnonzero(end - start >= size)
        right, left = end[stream].copy(), end[stream].copy()
        lo, hi = np.zeros(len(stream), np.int64), np.full(len(stream), self.n, np.int64)
        out_stream, out_at = [], []
        while len(stream):
            a, b = self.extend(text[left - 1], lo, hi)
            grown = b - a >= 2
            left = left - grown
            hit = grown & (right - left >= size)
            out_stream.append(stream[hit])
            out_at.append(left[hit])
            # Windows that start before ``left`` and hold this match end too late: the next end is one less, or a window away.
            right = np.where(grown, right, np.minimum(right - 1, left + size - 1))
            lo, hi = np.where(grown, a, 0), np.where(grown, b, self.n)
            left = np.where(grown, left, right)
            live = np.where(grown, left > start[stream], right - start[stream] >= size)
            stream, right, left, lo, hi = stream[live], right[live], left[live], lo[live], hi[live]
        return (np.concatenate(out_stream), np.concatenate(out_at)) if out_stream else (np.zeros(0, np.int64), np.zeros(0, np.int64))
