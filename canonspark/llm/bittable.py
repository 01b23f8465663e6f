"""A bit table of fixed size that answers whether a hash may be in a set.

No member is missed; a false member has a chance that grows with the set.  The table
is the same size whatever the set holds, so it may be broadcast; users of it only
save work by it and stay right when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return h & m, (h >> np.uint64(32)) & m


class Members:
    """Two bits a member; without a table nothing is one."""

    def __init__(self, table: np.ndarray | None):
        self.table = table

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(h), bool)
        out = np.ones(len(h), bool)
        for p in _places(h, len(self.table) * 64):
            out &= (self.table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def bit_table(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int = BITS) -> np.ndarray:
    """The table of ``rows``, whose batches ``hashes`` turns into 64-bit hashes; at most
    ``bits / 64`` rows of 16 bytes reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate(_places(hashes(batch), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((p >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["cell", "mask"])

    got = (rows.mapInArrow(run, "cell long, mask long").groupBy("cell").agg(F.expr("bit_or(mask)").alias("mask"))
           .toArrow())
    table = np.zeros(bits // 64, np.uint64)
    table[got["cell"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return table
