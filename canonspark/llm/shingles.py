"""Word shingles as sets of 64-bit fingerprints (numpy, inside tasks).

A shingle of ``k`` words is fingerprinted by mixing the 64-bit xxHash of its
words with odd multipliers.  Two different shingles of one pair of documents
share a fingerprint with probability 2**-64; all set sizes and intersections
are taken on fingerprints.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before; emptied when it holds
    ``limit`` words so that its memory is bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct fingerprints of the ``k``-word shingles; fewer than
    ``k`` words make one shingle of the whole sequence, no words none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    if n < k:
        acc = np.full(1, n, dtype=np.uint64)
        for x in h:
            acc = mix64(acc * _MULT + x)
        return acc
    acc = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = mix64(acc * _MULT + h[i : n - k + 1 + i])
    return np.unique(acc)
