"""Simple-8b word-aligned integer coding, vectorised with numpy.

A word is 64 bits: a four-bit selector on top and 60 bits of payload that hold as many ids as the
selector says, all of the same width, the first in the lowest bits. Ids of more than 60 bits are escaped:
the stream holds zero in their place and they travel in a side list of positions and values.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64(1 << 60)


_LIMITS = np.array([1 << w for w in WIDTHS[1:-1]], dtype=np.uint64)  # an id below the k-th limit fits selector k + 1
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _selectors(values: np.ndarray) -> np.ndarray:
    """At each position, the selector of the most ids if a word began there. What lies beyond the end counts as zero.

    The widest id of every window of a selector's length comes from the maxima of two shorter windows.
    """
    n = len(values)
    small = values.max() < len(_SMALL)
    wide = np.zeros(n + 240, np.uint8)
    wide[:n] = _SMALL[values.astype(np.intp)] if small else np.searchsorted(_LIMITS, values, side="right")
    best = np.full(n, 15, dtype=np.uint8)
    windows = {1: wide}
    for s in range(14, -1, -1):
        m = int(COUNTS[s])
        a = max(k for k in windows if k < m and 2 * k >= m)
        windows[m] = np.maximum(windows[a][: n + 240 - m + 1], windows[a][m - a : n + 240 - a + 1])
        # both selectors of width 0 take zeros only, which are wide[] == 0
        np.copyto(best, np.uint8(s), where=windows[m][:n] <= max(0, s - 1))
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the positions and values of the escaped ids."""
    values = np.asarray(values, dtype=np.uint64)
    big = np.flatnonzero(values >= ESCAPE)
    escaped = values[big]
    if len(big):
        values = values.copy()
        values[big] = 0
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), big, escaped
    best = _selectors(values)
    steps = COUNTS[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for s in np.unique(chosen):
        if WIDTHS[s]:
            at = chosen == s
            first, total = starts[at], words[at]
            for k in range(COUNTS[s]):
                total |= padded[first + k] << np.uint64(k * WIDTHS[s])
            words[at] = total
    return words, big, escaped


def decode(words: np.ndarray, n: int, positions: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` ids, all words of one selector at a time."""
    words = np.asarray(words, dtype=np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.intp)
    starts = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    out = np.zeros(n + 240, np.uint64)
    for s in np.unique(chosen):
        if WIDTHS[s]:
            at = chosen == s
            first, payload, mask = starts[at], words[at], np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                out[first + k] = (payload >> np.uint64(k * WIDTHS[s])) & mask
    out = out[:n]
    out[positions] = escaped
    return out
