"""Apply a learned value map (J11) to a stream with a stream-static join.

The value map ``(group_key, norm) -> suggestion`` is a static DataFrame; every
micro-batch normalises the column and left-joins the map.  A value that is
not in the map keeps its original text.  The join is stateless, so no
watermark is needed; progress is kept in the stream's checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.functions import text as T


def clean_column(df: DataFrame, value_map: DataFrame, column: str) -> DataFrame:
    """Works on batch and streaming frames alike: adds ``<column>_cleaned``."""
    vm = (value_map.where(F.col("group_key") == column)
          .select(F.col("norm").alias("_vm_norm"), F.col("suggestion").alias("_vm_sugg")))
    out = df.withColumn("_norm", T.normalize(column))
    out = out.join(vm, out["_norm"] == vm["_vm_norm"], "left")
    return (out.withColumn(f"{column}_cleaned",
                           F.when(F.col("_vm_norm").isNotNull(), F.col("_vm_sugg")).otherwise(F.col(column)))
            .drop("_norm", "_vm_norm", "_vm_sugg"))


def run_to_parquet(stream: DataFrame, value_map: DataFrame, column: str, out_path: str,
                   checkpoint: str) -> None:
    """Process everything available now, append to ``out_path``, stop."""
    q = (clean_column(stream, value_map, column).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
