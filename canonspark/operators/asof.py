"""Distributed as-of: the last earlier (or first later) non-null value within a key.

``Window.partitionBy(key)`` would put a hot key in one task.  Rows are
range-partitioned on ``(key, order)`` instead (a hot key spans partitions),
each (partition, key) chunk is scanned locally, and a small table of
per-(partition, key) last values carries the state across partition borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonspark.session import ensure_checkpoint_dir


def last_before(df: DataFrame, key_cols: list[str], order_cols: list[Column | str], value_col: str,
                out: str, num_partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the last non-null ``value_col`` strictly before each row
    (in ``order_cols`` order, which must be total within a key)."""
    return _nearest(df, key_cols, order_cols, value_col, out, num_partitions, False)


def first_after(df: DataFrame, key_cols: list[str], order_cols: list[Column | str], value_col: str,
                out: str, num_partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the first non-null ``value_col`` strictly after each row."""
    return _nearest(df, key_cols, order_cols, value_col, out, num_partitions, True)


def _nearest(df: DataFrame, key_cols: list[str], order_cols: list[Column | str], value_col: str,
             out: str, num_partitions: int | None, later: bool) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *key_cols, *order_cols).withColumn("_pid", F.spark_partition_id())
    ensure_checkpoint_dir(spark)
    s = s.checkpoint(eager=True)            # one copy: both uses see the same partitions
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]

    def ahead(cols: list[Column]) -> list[Column]:
        return [c.desc() for c in cols] if later else cols

    w = (Window.partitionBy("_pid", *key_cols).orderBy(*ahead(order))
         .rowsBetween(Window.unboundedPreceding, -1))
    local = s.withColumn("_loc", F.last(value_col, ignorenulls=True).over(w))
    # per (partition, key) chunk: the non-null value next to the border (NULL when it has none)
    edge = F.min_by if later else F.max_by
    chunks = (s.groupBy("_pid", *key_cols)
              .agg(edge(F.col(value_col), F.when(F.col(value_col).isNotNull(), F.struct(*order))).alias("_tail")))
    wc = (Window.partitionBy(*key_cols).orderBy(*ahead([F.col("_pid")]))
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = chunks.withColumn("_carry", F.last("_tail", ignorenulls=True).over(wc)).drop("_tail")
    return (local.join(carry, ["_pid", *key_cols], "left")
            .withColumn(out, F.coalesce("_loc", "_carry")).drop("_pid", "_loc", "_carry"))
