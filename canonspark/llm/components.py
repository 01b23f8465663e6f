"""Connected components of an edge table by alternating stars.

Each round rewires every node's larger neighbours to the smallest id it knows
(large star), then its smaller neighbours (small star); the number of rounds
grows with the logarithm of the longest path.  A round is two grouped minima
and two joins; the edges of a round are written with ``checkpoint()``.  Stops
when a round changes nothing, which is compared on an order-free checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.llm.textops import checkpoint


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**40)))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rewired = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select("a", F.col("m").alias("b"))
    return rewired.unionByName(own).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: every node of an edge with the
    smallest id it reaches.  Nodes without an edge are not in the result;
    self-loops and repeated edges are allowed, an empty table gives none."""
    cur = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a != b").distinct())
    state = _checksum(cur)
    while state[0]:
        cur = checkpoint(_small_star(_large_star(cur)))
        new = _checksum(cur)
        if new == state:
            break
        state = new
    return (cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")))
            .groupBy("id").agg(F.min("component").alias("component")))
