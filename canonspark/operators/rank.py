"""Row number within a group without putting a group into one task.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task; a group
may hold a third of all rows.  Here the rows are range-partitioned on
``(g, o)`` (a hot group spans many partitions), numbered locally after the
sort, and a small table of per-(partition, group) counts supplies offsets.
``(g, o)`` must be unique.  The locally numbered rows are checkpointed
once (shared checkpoint directory): both the counts and the final join read
that one copy, so two evaluations can never see different range bounds, and
a lost executor recomputes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canonspark.session import ensure_checkpoint_dir


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      out: str, start: int = 1, num_partitions: int | None = None) -> DataFrame:
    keys = [*group_cols, *order_cols]
    parts = (num_partitions,) if num_partitions else ()
    s = (df.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_li", F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ensure_checkpoint_dir(df.sparkSession)
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"),
                                                F.min("_li").alias("_lmin"))
    # one row for each partition that a group touches
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    res = s.join(offs, ["_pid", *group_cols])
    return (res.withColumn(out, (F.col("_li") - F.col("_lmin") + F.col("_off") + F.lit(start)).cast("long"))
            .drop("_pid", "_li", "_cnt", "_lmin", "_off"))
