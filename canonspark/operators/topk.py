"""Exact top-k per group without sending a whole group to one task.

Level 1 keeps the best k rows inside each (group, hash bucket) window, so a
hot group is spread over ``buckets`` tasks; level 2 ranks the at most
``k * buckets`` survivors of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    out: str = "rank", buckets: int = 256) -> DataFrame:
    b = df.withColumn("_tkb", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "_tkb").orderBy(*order)
    l1 = b.withColumn("_tkr", F.row_number().over(w1)).where(F.col("_tkr") <= k).drop("_tkr", "_tkb")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return l1.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)
