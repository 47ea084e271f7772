"""Anchors: a window's least gram by hash. Equal windows have equal anchors, so windows can be brought together by anchor.

Consecutive windows mostly share an anchor and travel as one run. An anchor that only one run has belongs to a repeated window
only if that run, being periodic, holds two equal windows itself; such a run counts twice (see ``inside``). So only runs with a
repeated anchor go on. Grams that very many documents share come last in the order: a
window that only touches a common passage is then held by a rarer gram, and a hot passage by itself forms equal runs, which
are added up before they are shuffled.
"""

from __future__ import annotations

import numpy as np

TOP = np.uint64(1 << 63)


_MASK = (1 << 20) - 1
#: The last array of common grams that was asked for, and its table.
_FILTER: list[np.ndarray] = []


def ordered(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Place of each gram in the order; ``hot`` (sorted gram hashes without the last bit) come last.

    A table of low bits rules nearly all grams out before any is looked up.
    """
    value = grams >> np.uint64(1)
    if len(hot):
        if not _FILTER or _FILTER[0] is not hot:
            table = np.zeros(_MASK + 1, bool)
            table[hot.view(np.int64) & _MASK] = True
            _FILTER[:] = [hot, table]
        maybe = np.flatnonzero(_FILTER[1][value.view(np.int64) & _MASK])
        near = value[maybe]
        at = np.minimum(np.searchsorted(hot, near), len(hot) - 1)
        value[maybe[hot[at] == near]] |= TOP
    return value


def sliding_min(value: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    if len(value) < width:
        return value[:0]
    step, low = 1, value
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs(low: np.ndarray, first: int, last: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, count) of the runs of windows first <= start < last, cut after ``most`` windows."""
    own = low[first:last]
    if not len(own):
        return own.view(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.append(begin, len(own)))
    if count.max() > most:
        parts = -(-count // most)
        offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
        count = np.minimum(most, np.repeat(count, parts) - offset)
        begin = np.repeat(begin, parts) + offset
    return own[begin].view(np.int64), begin, count


def near_repeats(value: np.ndarray, width: int, most: int) -> np.ndarray:
    """Every ``width``-th place whose gram stands again less than ``most`` places later.

    Two equal windows less than ``most`` apart agree in ``width`` grams in a row, and one of those is looked at.
    """
    probe = value[::width]
    hit = np.zeros(len(probe), bool)
    for step in range(1, most):
        later = value[step::width]
        hit[: len(later)] |= probe[: len(later)] == later
    return np.flatnonzero(hit) * width


def inside(value: np.ndarray, near: np.ndarray, anchor: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Anchors of the runs (in order, ``begin`` being places in ``value``) that hold two equal windows themselves.

    ``near`` are the places from ``near_repeats``. Anchors that two of the runs near them have are left out: they count twice as it is.
    """
    if not len(begin):
        return anchor
    near = near[np.searchsorted(near, begin[0]) : np.searchsorted(near, begin[-1] + count[-1] + width)]
    if not len(near):
        return anchor[:0]
    first, last = np.searchsorted(begin + count, near - width + 1, "right"), np.searchsorted(begin, near, "right")
    at = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist())]))
    _, which, times = np.unique(anchor[at], return_index=True, return_counts=True)
    at = at[which[times == 1]]
    held = [len({value[i : i + width].tobytes() for i in range(s, s + n)}) < n for s, n in zip(begin[at].tolist(), count[at].tolist())]
    return anchor[at[np.array(held, bool)]]
