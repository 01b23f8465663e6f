"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors of integers are cut into shards of at most about ``shard`` rows; a
shard is one task's index.  A dimension has two posting lists, for positive and
for negative query weights, so that every contribution counts upwards from a
base that depends on the query alone: with w > 0 the impact of x is x - min,
with w < 0 it is max - x.  Impacts are quantised into ``levels`` levels; the
postings of one list and level form a segment, and a list's postings lie in
descending order of level.

A query takes the segments of its lists in descending order of weight times
impact, a round of them at a time.  A segment's postings add its quantised impact,
once, to the lower bounds of the rows that are still alive.  What any row can gain
beyond its lower bound is bounded list by list: by the width of a level where the
row was met, by the best segment to come where it wasn't.  A row that can't reach
the k-th best lower bound is given up, on proof.  When few rows are left, or all
segments are taken, the rows left are scored again exactly: nothing is
approximate, ties included.

Every shard gets all queries as a stream behind its rows, so rows are shuffled once
and no side is broadcast.  A shard gives at most k rows for each query, and a
two-level top-k merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canonspark.llm.textops import written

SHARD, LEVELS, ROUNDS = 32_768, 64, 24
EXACT = 1 << 23  # components up to this are indexed; sums of their products fit 64 bits
LONG = 1 << 63


class ImpactIndex:
    """The index of one shard: an integer matrix, a row for each vector."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        low, high = x.min(axis=0), x.max(axis=0)
        self.span = np.concatenate([high - low, high - low])
        self.width = np.maximum(1, -(-(self.span + 1) // levels))
        lists, kind = 2 * x.shape[1], np.int32
        self.postings = np.empty((lists, len(x)), kind)
        segments = []
        for j in range(lists):
            d = j % x.shape[1]
            level = (x[:, d] - low[d] if j < x.shape[1] else high[d] - x[:, d]) // self.width[j]
            order = np.argsort(-level, kind="stable")
            self.postings[j] = order
            cuts = np.flatnonzero(np.diff(level[order], prepend=level[order[0]] + 1))
            segments.append(np.stack([np.full(len(cuts), j), level[order][cuts], cuts, np.append(cuts[1:], len(x))], axis=1))
        # list, level, first and last posting of every segment
        self.list, self.level, self.first, self.last = np.concatenate(segments).T
        self.at = self.level * self.width[self.list]
        self.top = np.minimum(self.at + self.width[self.list] - 1, self.span[self.list])
        self.touched = 0  # postings added so far

    def search(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows left for a query (all of the k best among them) and their exact
        scores.  ``skip``: rows that take no part."""
        weight = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)])
        mine = np.flatnonzero(weight[self.list] > 0)
        mine = mine[np.argsort(-(weight[self.list[mine]] * self.top[mine]), kind="stable")]
        lists, gain = self.list[mine], weight[self.list[mine]] * self.at[mine]
        alive = ~skip
        bound = np.zeros(len(self.x), np.int64)
        # what a row can gain in a list: before it is met there, and after
        unmet, met = weight * self.span, weight * (self.width - 1)
        size = np.cumsum(self.last[mine] - self.first[mine])
        cuts = np.searchsorted(size, np.arange(1, ROUNDS + 1) * (size[-1] / ROUNDS)) if len(mine) else []
        begin = 0
        for end in np.unique(np.minimum(np.append(np.asarray(cuts, int) + 1, len(mine)), len(mine))):
            if end == begin or int(alive.sum()) <= 4 * k:
                break
            some = mine[begin:end]
            rows = np.concatenate([self.postings[j, a:b] for j, a, b in zip(lists[begin:end], self.first[some], self.last[some])])
            gains = np.repeat(gain[begin:end], self.last[some] - self.first[some])
            on = alive[rows]
            self.touched += int(on.sum())
            np.add.at(bound, rows[on], gains[on])
            begin = int(end)
            # a list's segments are taken from the top, so the next one bounds what is unmet
            unmet = np.zeros_like(unmet)
            rest = mine[begin:]
            np.maximum.at(unmet, self.list[rest], weight[self.list[rest]] * self.top[rest])
            left = np.flatnonzero(alive)
            if len(left) > k:
                kth = np.partition(bound[left], len(left) - k)[len(left) - k]
                alive[left[bound[left] + int(np.maximum(unmet, met).sum()) < kth]] = False
        rows = np.flatnonzero(alive)
        return rows, self.x[rows] @ q


class _Shard:
    """One task's rows, by their number of components."""

    def __init__(self, ids: list, vectors: list):
        self.ids = np.array(ids, dtype=np.int64)
        x = np.array(vectors, dtype=np.float64)
        self.index = None
        if np.abs(x).max(initial=0) <= EXACT:
            self.index = ImpactIndex(x.astype(np.int64))
        else:  # a component too large for the bounds' arithmetic: Python integers
            self.large = _integers(x)

    def best(self, query_id: int, v, k: int) -> list[tuple[int, int, int]]:
        skip, q = self.ids == query_id, np.array(v, dtype=np.float64)
        if self.index is not None and np.abs(q).max(initial=0) <= EXACT:
            rows, score = self.index.search(q.astype(np.int64), k, skip)
        else:
            x = self.large if self.index is None else self.index.x.astype(object)
            rows = np.flatnonzero(~skip)
            score = x[rows] @ _integers(q) if len(rows) else rows
        order = sorted(range(len(rows)), key=lambda j: (-score[j], self.ids[rows[j]]))[:k]
        return [(query_id, int(self.ids[rows[j]]), int(score[j])) for j in order]


def _integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [int(e) for e in x.ravel().tolist()]
    return out


def _search(k: int):
    """Rows arrive sorted by shard, dimensions and side: a shard's vectors, then the queries."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, vectors, shard = None, [], [], None
        for pdf in batches:
            out = []
            for own in zip(pdf["shard"], pdf["dims"], pdf["asks"], pdf["vec_id"], pdf["v"]):
                if own[:2] != key:
                    key, ids, vectors, shard = own[:2], [], [], None
                if not own[2]:
                    ids.append(own[3])
                    vectors.append(own[4])
                elif ids:
                    shard = shard or _Shard(ids, vectors)
                    out += shard.best(int(own[3]), own[4], k)
            # a score that doesn't fit a long is marked as above (1) or below (-1) all that do
            beyond = [(x[2] >= LONG) - (x[2] < -LONG) for x in out]
            yield pd.DataFrame({"query_id": [x[0] for x in out], "vec_id": [x[1] for x in out],
                                "score": [0 if b else x[2] for b, x in zip(beyond, out)], "beyond": beyond})

    return run


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """``(vec_id, v array<double>)``: floor(scale * x) of every component, x as
    double; whole numbers of any size.  Vectors that are null, empty, or hold null or
    non-finite components are left out, as are null ids."""
    x = F.transform("embedding", lambda e: e.cast("double") * scale)
    ok = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform("x", lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e).cast("double")).otherwise(e))
    return (embeddings.where("vec_id is not null and embedding is not null")
            .where((F.size("embedding") > 0) & F.coalesce(ok, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).select("vec_id", whole.alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """``vectors(vec_id, v)`` and ``queries(vec_id, v)``, arrays of whole numbers -> the k
    rows of highest inner product of each query (all, if fewer), its own id left
    out: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties to the smaller
    vec_id.  Components may have any size; a score among the k best that doesn't
    fit a long is an error.  Vectors of another length than a query have no score
    with it.  Rows that repeat an id count as candidates each, a repeated query id is
    asked once (its smallest vector).  Empty tables give an empty result."""
    v = F.transform("v", lambda e: e.cast("double")).alias("v")
    data = written(vectors.select("vec_id", v, F.size("v").alias("dims")), "vectors")
    asked = (queries.select("vec_id", v).groupBy("vec_id").agg(F.min("v").alias("v"))
             .withColumn("dims", F.size("v")))
    shards = max(1, -(-data.count() // shard))
    base = (data.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("long"))
            .withColumn("asks", F.lit(False)))
    ask = (asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
           .withColumn("asks", F.lit(True)))
    both = base.unionByName(ask.select(*base.columns))
    found = (both.repartition(shards, "shard").sortWithinPartitions("shard", "dims", "asks")
             .mapInPandas(_search(k), "query_id long, vec_id long, score long, beyond int"))
    # merged in two levels: no more than k * 256 rows of a query meet
    order = [F.col("beyond").desc(), F.col("score").desc(), F.col("vec_id")]
    part = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
    last = Window.partitionBy("query_id").orderBy(*order)
    best = first.where(F.col("r") <= k).withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k)
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(
        F.raise_error(F.lit("a score among the best does not fit 64 bits")).cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
