"""X1 with unseen values: cluster the values of a stream as they come.

Leader clustering looks back only: a value joins its earliest similar leader or
opens a cluster, whatever comes later.  So a micro-batch needs the leaders found
so far and nothing else.  Its unseen values are matched to them, and to each other,
by the same exact prefix-filter join and the same rounds as in batch, and the
batch's values are written beside those of earlier batches.  After any number of
batches the state equals the batch result on the same order (batch, row id).

The state is a folder a batch below ``state``, written with overwrite: a batch that
is run again after a failure writes the same rows in the same place, and reads
only the batches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonspark.functions import text as T
from canonspark.operators import cluster as CL
from canonspark.operators import pairs as PR
from canonspark.operators.reshape import quoted
from canonspark.session import ensure_checkpoint_dir

OCC = "struct<col_ord:int,row_id:bigint>"
STATE = f"group_key string, norm string, occ {OCC}, leader {OCC}, batch int"


def values(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """All values learned: ``group_key, norm, occ, leader, batch`` (``leader``: the occurrence
    that leads the value's cluster); of the batches below ``before``."""
    if before == 0:
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE).parquet(state)
    return rows if before is None else rows.where(F.col("batch") < before)


def learn_batch(rows: DataFrame, batch: int, column: str, row_id: str, state: str,
                scorer: str = "ratio", threshold: float = 75) -> None:
    """One micro-batch.  Null and blank values, and such that normalise to nothing, are not learned."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    known = values(spark, state, batch)
    norm = T.normalize(quoted(column))
    seen = (rows.select(F.lit(column).alias("group_key"), norm.alias("norm"), F.struct(
        F.lit(batch).alias("col_ord"), quoted(row_id).cast("long").alias("row_id")).alias("occ"))
        .where("norm is not null and norm <> ''").groupBy("group_key", "norm").agg(F.min("occ").alias("occ")))
    new = seen.join(known, ["group_key", "norm"], "left_anti").checkpoint(eager=True)
    leaders = known.where("occ = leader").select("group_key", "norm", "occ")
    nodes = leaders.unionByName(new).withColumn("n", F.lit(1).cast("long")).checkpoint(eager=True)
    # no two leaders are similar, so every edge has an unseen value
    edges = PR.fuzzy_edges(nodes, scorer, threshold)
    lab = CL.assign_leaders(nodes, edges, "leader").where(F.col("occ.col_ord") == batch)
    lab.select("group_key", "norm", "occ", "leader").write.mode("overwrite").parquet(f"{state}/batch={batch}")


def learn(stream: DataFrame, column: str, row_id: str, state: str, checkpoint: str,
          scorer: str = "ratio", threshold: float = 75) -> None:
    """Learn from everything available now, batch by batch, and stop."""
    q = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(lambda rows, batch: learn_batch(rows, int(batch), column, row_id, state, scorer, threshold))
         .start())
    q.awaitTermination()


def clusters(spark: SparkSession, state: str) -> DataFrame:
    """``group_key, norm, occ, leader, cluster_id, cluster_tag``: clusters numbered in order of formation."""
    return CL.number_clusters(values(spark, state).drop("batch"))
