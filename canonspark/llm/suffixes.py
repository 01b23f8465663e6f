"""Local suffix sorting: multikey quicksort and longest common prefixes."""

from __future__ import annotations

import numpy as np


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (suffixes cut into big-endian 8-byte
    words).  A range is split in three by the median word at its depth; the
    middle part goes one word deeper.  Words that a whole range shares are
    skipped at once.  An explicit stack keeps the recursion bounded."""
    n, width = words.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth >= width:
            continue
        part = order[lo:hi]
        differs = (words[part, depth:] != words[part[0], depth:]).any(axis=0)
        if not differs.any():
            continue
        depth += int(differs.argmax())
        key = words[part, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, equal = key < pivot, key == pivot
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        mid = lo + int(less.sum())
        top = mid + int(equal.sum())
        stack += [(lo, mid, depth), (mid, top, depth + 1), (top, hi, depth)]
    return order


def common_prefixes(sorted_bytes: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that sorted rows i-1 and i share from the start; lcp[0] = 0."""
    n, width = sorted_bytes.shape
    lcp = np.zeros(n, dtype=np.int32)
    step = 8192
    for i in range(1, n, step):
        j = min(n, i + step)
        differs = sorted_bytes[i:j] != sorted_bytes[i - 1 : j - 1]
        lcp[i:j] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return lcp


def padded(parts: list[bytes], width: int, right: bool = False) -> np.ndarray:
    """Rows of ``width`` bytes, zero-filled at the end (or at the front)."""
    pad = (lambda b: b.rjust(width, b"\0")) if right else (lambda b: b.ljust(width, b"\0"))
    return np.frombuffer(b"".join(map(pad, parts)), dtype=np.uint8).reshape(len(parts), width)


def repeated_offsets(left: list[bytes], right: list[bytes], lowest: np.ndarray, highest: np.ndarray,
                     window: int) -> list[tuple[int, int, int]]:
    """Suffixes ``right`` with the bytes ``left`` before them.  Row r serves the
    windows that start ``o`` bytes before its suffix, lowest[r] <= o <=
    highest[r].  Returns runs (r, first o, last o) of windows whose bytes some
    other row's window with the same o has too.

    Windows at o are equal iff their suffixes share ``window - o`` bytes (one
    run of the sorted suffixes between smaller common prefixes) and the o bytes
    before are equal (compared by a running 64-bit hash)."""
    n = len(right)
    width = -(-window // 8) * 8
    suffixes = padded(right, width)
    order = multikey_quicksort(suffixes.view(">u8"))
    lcp = common_prefixes(suffixes[order])
    reach = int(highest.max()) + 1
    before = padded(left, max(reach, 1), right=True)[order]
    low, high = lowest[order], highest[order]
    hit = np.zeros((n, reach), dtype=bool)
    h = np.zeros(n, dtype=np.uint64)
    for o in range(reach):
        if o:
            h = (h + before[:, -o].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        run = np.cumsum(lcp < window - o).astype(np.uint64)[live]
        by = np.lexsort((h[live], run))
        r, x = run[by], h[live][by]
        same = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
        twin = np.zeros(len(live), dtype=bool)
        twin[1:] |= same
        twin[:-1] |= same
        hit[live[by[twin]], o] = True
    edge = np.zeros((n, 1), dtype=np.int8)
    step = np.diff(np.concatenate([edge, hit.astype(np.int8), edge], axis=1), axis=1)
    rows, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return [(int(order[a]), int(b), int(c) - 1) for a, b, c in zip(rows, first, last)]
