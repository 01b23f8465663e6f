"""Similarity kernels over a whole Arrow batch of pairs; no Python loop over pairs.

* ``lcs_lengths``: the bit-parallel recurrence for the longest common subsequence, one
  machine word (or a few) a pair, all pairs of a chunk at once.
* ``partial_scores``: the best ratio of the shorter text with a window of the longer one.
  One combing pass per pair (strands that cross at most once) gives, for every end in the
  longer text, where the strand that ends there began; the common subsequence of the
  shorter text with *every* substring of the longer one is a count over these.

Pairs are sorted by length, so that a chunk's texts are padded little.  Padding
characters match nothing, and both methods are indifferent to them.
"""

from __future__ import annotations

import numpy as np

CELLS = 1 << 21  # cells of a chunk's comparison table: bounds its memory


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each begins."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def _small(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same characters as numbers from 2 on, in the smallest type that holds them."""
    seen = np.zeros(max(a.max(initial=0), b.max(initial=0)) + 1, bool)
    seen[a] = True
    seen[b] = True
    number = np.cumsum(seen) + 1
    kind = np.uint8 if number[-1] < 256 else np.uint16 if number[-1] < 65536 else np.uint32
    number = number.astype(kind)
    return number[a], number[b]


def _padded(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, pad: int) -> np.ndarray:
    place = np.arange(width)
    got = data.take(start[:, None] + place, mode="clip") if len(data) else np.zeros((len(start), width), data.dtype)
    got[place >= length[:, None]] = pad
    return got


def _chunks(order: np.ndarray, rows: np.ndarray, columns: np.ndarray):
    """Slices of ``order`` (longest last) whose padded tables have about ``CELLS`` cells."""
    at = 0
    while at < len(order):
        size = max(int(rows[order[at]]) * int(columns[order[at]]), 1)
        end = min(len(order), at + max(1, CELLS // size))
        # sizes grow along the order: shrink until the largest fits too
        while end - at > 1:
            some = order[at:end]
            if (end - at) * int(rows[some].max()) * int(columns[some].max()) <= 2 * CELLS:
                break
            end = at + (end - at + 1) // 2
        yield order[at:end]
        at = end


def _lcs_chunk(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``pattern`` (pairs x width, a multiple of 64) in bits, ``text`` column by column."""
    pairs, width = pattern.shape
    words = width // 64
    v = np.full((words, pairs), ~np.uint64(0))
    for j in range(text.shape[1]):
        hit = np.packbits(pattern == text[:, j:j + 1], axis=1, bitorder="little").view(np.uint64)
        carry = None
        for w in range(words):
            m = hit[:, w]
            u = v[w] & m
            total = v[w] + u
            over = total < u
            if carry is not None:
                total = total + carry
                over |= total < carry
            v[w] = total | (v[w] & ~m)
            carry = over.astype(np.uint64)
    return np.bitwise_count(~v).sum(axis=0).astype(np.int64)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of every pair (by characters)."""
    a_data, a_at = _codes(a)
    b_data, b_at = _codes(b)
    a_data, b_data = _small(a_data, b_data)
    la, lb = np.diff(a_at), np.diff(b_at)
    out = np.zeros(len(a), np.int64)
    data = np.concatenate([a_data, b_data]) if len(a_data) + len(b_data) else a_data
    swap = la > lb  # the longer text in bits: fewer steps
    long_at = np.where(swap, a_at[:-1], b_at[:-1] + len(a_data))
    short_at = np.where(swap, b_at[:-1] + len(a_data), a_at[:-1])
    long, short = np.maximum(la, lb), np.minimum(la, lb)
    blocks = -(-long // 64) * 64
    live = np.flatnonzero(short > 0)
    order = live[np.lexsort((short[live], blocks[live]))]
    for some in _chunks(order, blocks, np.ones_like(short)):
        pattern = _padded(data, long_at[some], long[some], int(blocks[some].max()), 0)
        text = _padded(data, short_at[some], short[some], int(short[some].max()), 1)
        out[some] = _lcs_chunk(pattern, text)
    return out


def _combed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Comb ``a`` (rows x pairs) with ``b`` (columns x pairs), one diagonal at a time.

    Strands start on the left (numbered from the bottom) and on the top, and run right
    and down; two strands that meet cross, unless the characters match or they have
    crossed before.  Returns for every column where the strand that ends at its bottom
    began: the column (from 0), or a negative number for one from the left."""
    m, n = len(a), len(b)
    kind = np.int16 if m + n < 32000 else np.int32
    left = np.repeat((np.arange(m, dtype=kind)[::-1] - kind(m))[:, None], a.shape[1], axis=1)
    top = np.repeat(np.arange(n, dtype=kind)[:, None], a.shape[1], axis=1)
    for d in range(m + n - 1):
        i0, i1 = max(0, d - n + 1), min(m - 1, d)
        rows = slice(i0, i1 + 1)
        columns = slice(d - i0, d - i1 - 1 if d > i1 else None, -1)
        h, v = left[rows], top[columns]
        turn = (a[rows] == b[columns]) | (h > v)
        left[rows], top[columns] = np.where(turn, v, h), np.where(turn, h, v)
    return top


def _best_window(began: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best ratio over the windows, from where the strands of every end began."""
    columns, pairs = began.shape
    place = np.arange(columns, dtype=np.int64)[:, None]
    s = np.where(place < n, began, -1).astype(np.int64)
    pair = np.arange(pairs)

    def score(lcs, width, valid):
        total = m + width
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (1.0 - (total - 2 * lcs) / total) * 100.0
        return np.where(valid, value, 0.0).max(axis=0) if len(value) else np.zeros(pairs)

    # beginnings: all strands of the window's ends that came from the left
    heads = np.cumsum((began < 0) & (place < n), axis=0)
    best = score(heads, place + 1, place + 1 < m)
    # windows of m characters: a strand from s to r lies in those that start in (r - m, s]
    first = np.maximum(place - m + 1, 0)
    inside = (s >= first) & (place < n)
    width = columns + 1
    change = (np.bincount((first * pairs + pair)[inside], minlength=width * pairs)
              - np.bincount(((s + 1) * pairs + pair)[inside], minlength=width * pairs)).reshape(width, pairs)
    lost = np.cumsum(change, axis=0)[:-1]
    best = np.maximum(best, score(m - lost, np.broadcast_to(m, lost.shape), place <= n - m))
    # ends: strands that began in the window
    counts = np.bincount((np.maximum(s, 0) * pairs + pair)[s >= 0], minlength=columns * pairs).reshape(columns, pairs)
    lost = np.cumsum(counts[::-1], axis=0)[::-1]
    return np.maximum(best, score(n - place - lost, n - place, (place > n - m) & (place > 0) & (place < n)))


def _directed(short: list[str], long: list[str]) -> np.ndarray:
    """Best ratio of every ``short`` (not empty) against the windows of its ``long``."""
    s_data, s_at = _codes(short)
    l_data, l_at = _codes(long)
    s_data, l_data = _small(s_data, l_data)
    m, n = np.diff(s_at), np.diff(l_at)
    out = np.zeros(len(short))
    order = np.lexsort((n, m))
    for some in _chunks(order, m + n, np.full(len(m), 8)):
        a = _padded(s_data, s_at[some], m[some], int(m[some].max()), 0).T
        b = _padded(l_data, l_at[some], n[some], int(n[some].max()), 1).T
        began = _combed(np.ascontiguousarray(a), np.ascontiguousarray(b))
        out[some] = _best_window(began, m[some], n[some])
    return out


def partial_scores(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio (0-100) of the shorter text of every pair with a window of the longer
    one; texts of one length are tried both ways."""
    out = np.zeros(len(a))
    pairs = list(zip(a, b))
    out[[i for i, (x, y) in enumerate(pairs) if not x and not y]] = 100.0
    live = [i for i, (x, y) in enumerate(pairs) if x and y]
    if live:
        both = [pairs[i] if len(pairs[i][0]) <= len(pairs[i][1]) else pairs[i][::-1] for i in live]
        got = _directed([x for x, _ in both], [y for _, y in both])
        level = [k for k, (x, y) in enumerate(both) if len(x) == len(y)]
        if level:
            got[level] = np.maximum(got[level], _directed([both[k][1] for k in level], [both[k][0] for k in level]))
        out[live] = got
    return out
