"""Fuzzy string scorers (0-100), selectable by name.

Two kernels run in Arrow batches on candidate pairs, a whole batch at a time
(``functions.batch``): the common subsequence and the best window.  Everything
else of a score (words, sets, weights) is a JVM expression: ``score_column``.
The per-pair functions below state the definitions; ``SCORERS`` lists them.

Definitions follow the public documentation of the common fuzzy-matching
scorers: ``ratio`` is the normalised Indel similarity
``100 * (1 - (la + lb - 2 * LCS) / (la + lb))`` (two empty strings give 100),
the token variants split on whitespace, the partial variants take the best
``ratio`` of the shorter string against every window of the longer one.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonspark.functions import batch
from canonspark.functions.text import words


# ---------------------------------------------------------------- kernels

def lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _norm_sim(lcs: int, lensum: int) -> float:
    if lensum == 0:
        return 100.0
    return (1.0 - (lensum - 2 * lcs) / lensum) * 100.0


def ratio(a: str, b: str) -> float:
    return _norm_sim(lcs_len(a, b), len(a) + len(b))


def _partial_windows(short: str, long: str) -> float:
    ls, ll = len(short), len(long)
    best = 0.0
    chars = set(short)
    # windows clipped at the start
    for i in range(1, ls):
        if long[i - 1] in chars:
            best = max(best, ratio(short, long[:i]))
            if best == 100.0:
                return best
    # full windows
    for i in range(0, ll - ls + 1):
        if long[i + ls - 1] in chars:
            best = max(best, ratio(short, long[i:i + ls]))
            if best == 100.0:
                return best
    # windows clipped at the end
    for i in range(max(ll - ls + 1, 1), ll):
        if long[i] in chars:
            best = max(best, ratio(short, long[i:]))
            if best == 100.0:
                return best
    return best


def partial_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _partial_windows(short, long)
    if best != 100.0 and len(a) == len(b):
        best = max(best, _partial_windows(long, short))
    return best


def _sorted_join(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_join(a), _sorted_join(b))


def token_set_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    inter = ta & tb
    dab, dba = ta - tb, tb - ta
    if inter and (not dab or not dba):
        return 100.0
    sect = " ".join(sorted(inter))
    ab = " ".join(sorted(dab))
    ba = " ".join(sorted(dba))
    t1 = (sect + " " + ab).strip()
    t2 = (sect + " " + ba).strip()
    best = ratio(t1, t2)
    if sect:
        best = max(best, ratio(sect, t1), ratio(sect, t2))
    return best


def token_ratio(a: str, b: str) -> float:
    return max(token_set_ratio(a, b), token_sort_ratio(a, b))


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(_sorted_join(a), _sorted_join(b))


def partial_token_set_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    if ta & tb:
        return 100.0
    return partial_ratio(" ".join(sorted(ta - tb)), " ".join(sorted(tb - ta)))


def partial_token_ratio(a: str, b: str) -> float:
    sa, sb = a.split(), b.split()
    ta, tb = set(sa), set(sb)
    if ta & tb:
        return 100.0
    dab, dba = ta - tb, tb - ta
    best = partial_ratio(" ".join(sorted(sa)), " ".join(sorted(sb)))
    if len(sa) == len(dab) and len(sb) == len(dba):
        return best
    return max(best, partial_ratio(" ".join(sorted(dab)), " ".join(sorted(dba))))


def qratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return ratio(a, b)


# Weights of the weighted ratio
UNBASE_SCALE = 0.95
PARTIAL_SCALE = 0.9
LONG_PARTIAL_SCALE = 0.6
LONG_RATIO = 8.0
PARTIAL_FROM = 1.5


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    la, lb = len(a), len(b)
    len_ratio = la / lb if la > lb else lb / la
    best = ratio(a, b)
    if len_ratio < PARTIAL_FROM:
        return max(best, token_ratio(a, b) * UNBASE_SCALE)
    scale = PARTIAL_SCALE if len_ratio < LONG_RATIO else LONG_PARTIAL_SCALE
    best = max(best, partial_ratio(a, b) * scale)
    return max(best, partial_token_ratio(a, b) * UNBASE_SCALE * scale)


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio,
    "partial_ratio": partial_ratio,
    "token_sort_ratio": token_sort_ratio,
    "token_set_ratio": token_set_ratio,
    "token_ratio": token_ratio,
    "partial_token_sort_ratio": partial_token_sort_ratio,
    "partial_token_set_ratio": partial_token_set_ratio,
    "partial_token_ratio": partial_token_ratio,
    "QRatio": qratio,
    "WRatio": wratio,
}


def check_scorer(name: str) -> Callable[[str, str], float]:
    """Reject an unknown scorer before any job runs."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


# ------------------------------------------------------------ Spark glue

def _on_known(kernel, empty):
    """The kernel over the rows where both texts are known."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = pd.Series([None] * len(a), dtype=empty)
        if known.any():
            out[known] = kernel(a[known].tolist(), b[known].tolist())
        return out

    return run


_lcs, _partial = _on_known(batch.lcs_lengths, "Int32"), _on_known(batch.partial_scores, "Float64")


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _lcs(a, b)


@F.pandas_udf(T.DoubleType())
def partial_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _partial(a, b)


def ratio_from_lcs(lcs, la, lb):
    """The Indel ratio as a JVM expression, same float steps as the kernel."""
    lensum = la + lb
    return (F.when(lensum == 0, F.lit(100.0))
            .otherwise((F.lit(1.0) - (lensum - F.lit(2) * lcs) / lensum) * F.lit(100.0)))


def _ratio(a: Column, b: Column) -> Column:
    return ratio_from_lcs(lcs_udf(a, b), F.length(a), F.length(b))


class _Words:
    """Words of a pair, their sets and differences, as JVM expressions."""

    def __init__(self, a: Column, b: Column):
        self.a, self.b = a, b
        self.common = F.array_sort(F.array_intersect(self.a, self.b))
        self.only_a = F.array_sort(F.array_except(self.a, self.b))
        self.only_b = F.array_sort(F.array_except(self.b, self.a))
        self.in_order = F.array_join(F.array_sort(self.a), " "), F.array_join(F.array_sort(self.b), " ")
        self.rests = F.array_join(self.only_a, " "), F.array_join(self.only_b, " ")
        self.wordless = (F.size(self.a) == 0) | (F.size(self.b) == 0)


def _token_set(w: _Words) -> Column:
    shared = F.size(w.common) > 0
    inside = shared & ((F.size(w.only_a) == 0) | (F.size(w.only_b) == 0))
    sect = F.array_join(w.common, " ")
    full = [F.array_join(F.concat(w.common, rest), " ") for rest in (w.only_a, w.only_b)]
    known = ~w.wordless & ~inside
    lists = _ratio(F.when(known, full[0]), F.when(known, full[1]))
    # the common words begin both lists, so they are their own common subsequence
    n = F.length(sect)
    parts = [F.when(shared, ratio_from_lcs(n, n, F.length(x))).otherwise(F.lit(0.0)) for x in full]
    return F.when(w.wordless, 0.0).when(inside, 100.0).otherwise(F.greatest(lists, *parts))


def _partial_token_set(w: _Words) -> Column:
    apart = ~w.wordless & (F.size(w.common) == 0)
    return (F.when(w.wordless, 0.0).when(F.size(w.common) > 0, 100.0)
            .otherwise(partial_udf(F.when(apart, w.rests[0]), F.when(apart, w.rests[1]))))


def _partial_token(w: _Words, when: Column | None = None) -> Column:
    apart = F.size(w.common) == 0
    whole = (F.size(w.a) == F.size(w.only_a)) & (F.size(w.b) == F.size(w.only_b))
    first, second = (apart, apart & ~whole) if when is None else (when & apart, when & apart & ~whole)
    best = partial_udf(F.when(first, w.in_order[0]), F.when(first, w.in_order[1]))
    rest = partial_udf(F.when(second, w.rests[0]), F.when(second, w.rests[1]))
    return F.when(~apart, 100.0).when(whole, best).otherwise(F.greatest(best, rest))


def _weighted(a: Column, b: Column, w: _Words) -> Column:
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    empty = (la == 0) | (lb == 0)
    share = F.when(empty, 1.0).when(la > lb, la / lb).otherwise(lb / la)
    best, close = _ratio(a, b), share < PARTIAL_FROM
    scale = F.when(share < LONG_RATIO, PARTIAL_SCALE).otherwise(LONG_PARTIAL_SCALE)
    token = F.greatest(_token_set(w), _ratio(*w.in_order)) * UNBASE_SCALE
    part = F.greatest(best, partial_udf(F.when(~close, a), F.when(~close, b)) * scale)
    part = F.greatest(part, _partial_token(w, ~close) * F.lit(UNBASE_SCALE) * scale)
    return F.when(empty, 0.0).when(close, F.greatest(best, token)).otherwise(part)


def score_column(name: str, a, b, words_a: Column | None = None, words_b: Column | None = None) -> Column:
    """The score of two text columns: two batched kernels, all else in the JVM.
    ``words_a`` and ``words_b``: their words, where a column holds them already."""
    check_scorer(name)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    w = _Words(words(a) if words_a is None else words_a, words(b) if words_b is None else words_b)
    if name == "ratio":
        return _ratio(a, b)
    if name == "QRatio":
        return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(_ratio(a, b))
    if name == "token_sort_ratio":
        return _ratio(*w.in_order)
    if name == "token_set_ratio":
        return _token_set(w)
    if name == "token_ratio":
        return F.greatest(_token_set(w), _ratio(*w.in_order))
    if name == "partial_ratio":
        return partial_udf(a, b)
    if name == "partial_token_sort_ratio":
        return partial_udf(*w.in_order)
    if name == "partial_token_set_ratio":
        return _partial_token_set(w)
    if name == "partial_token_ratio":
        return _partial_token(w)
    return _weighted(a, b, w)
