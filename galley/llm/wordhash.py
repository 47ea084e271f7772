"""Words of many texts at once: borders and 64-bit hashes by numpy, without an object per word."""

from __future__ import annotations

import numpy as np

#: Words are runs of bytes other than these, which is the same as runs of characters other than these.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, n)
    if size not in _TABLES:
        if size > _BLOCK:
            return _powers(BASE, size), _powers(_INVERSE, size)
        _TABLES[size] = (_powers(BASE, size), _powers(_INVERSE, size))
    return _TABLES[size]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, end, first): the joined bytes, the borders of all words in it, and the number of the first word of each
    text, with one more entry for the end."""
    body = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    is_space = SPACE[body]
    before = np.concatenate([[True], is_space[:-1]])
    start = np.flatnonzero(~is_space & before)
    end = np.flatnonzero(is_space & ~before)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return body, start, end, np.searchsorted(start, offsets)


def hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from its bytes and length. Works in blocks, so that a very long text needs little memory."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _BLOCK - 1, "right")))
        a, b = start[lo], end[hi - 1]
        up, down = _tables(int(b - a))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((body[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], dtype=np.uint64)])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; runs are not checked for borders of texts."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + h[k : len(h) - size + 1 + k]
    return mix(out)
