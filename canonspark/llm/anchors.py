"""Anchors of byte windows: positions that a window's own bytes choose.

The anchor of a window of ``window`` bytes is the start of its ``gram``-byte
string with the smallest hash (the leftmost of equal ones).  Two windows with
the same bytes have their anchor at the same offset, so equal windows can only
be found among windows whose anchors start with the same gram.  Consecutive
windows mostly share an anchor: a text has about ``2 / (window - gram)``
anchors a byte.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
# positions within a part of a text; longer texts are taken in parts
_POS_MASK = np.uint64((1 << 28) - 1)
PART = 1 << 24  # windows that are taken at once: bounds memory too
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    """1, B, B**2, ... modulo 2**64, grown on demand."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every ``gram``-byte string, equal for equal strings.

    sum(b[p+i] * B**i) for i < gram, taken from prefix sums and divided by
    B**p (B is odd, so it has an inverse modulo 2**64)."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(n), out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * _inverse_table(n - gram + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


_inverses = np.ones(1, dtype=np.uint64)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _inverse_table(n: int) -> np.ndarray:
    global _inverses
    while len(_inverses) < n:
        step = np.uint64(pow(_INVERSE, len(_inverses), 1 << 64))
        _inverses = np.concatenate([_inverses, _inverses * step])
    return _inverses[:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, from running minima within
    blocks of ``w`` in both directions."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def window_anchors(data: np.ndarray, window: int, gram: int):
    """Anchors of all windows of a text: positions, first and last window start
    served by each, and the gram's hash."""
    n = len(data)
    if n < window:
        e = np.empty(0, dtype=np.int64)
        return e, e, e, e
    if n > PART + window:
        parts = []
        for a in range(0, n - window + 1, PART):
            at, first, last, h = window_anchors(data[a : a + PART + window - 1], window, gram)
            parts.append((at + a, first + a, last + a, h))
        return tuple(map(np.concatenate, zip(*parts)))
    h = gram_hashes(data, gram)
    order = (h & ~_POS_MASK) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(order, window - gram + 1) & _POS_MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first, last, h[at[first]].astype(np.int64)
