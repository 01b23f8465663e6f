"""Save cleaning runs as transactions and read a user's history.

Below ``path`` (a shared folder) every run has folders of its own:

* ``summaries/user_id=<u>/clean_id=<id>``: its summary rows, staged first;
* ``cleans/user_id=<u>/clean_id=<id>``: its run row, one file that Spark's commit moves into place
  in one step.  This is the manifest: a run exists when its manifest does.

Readers start from the manifests, so they never see a run without its summaries
or the rows of a save that didn't end.  The id of a run follows from its content, so
saving it again (after a failure, or by a repeated request) overwrites what was
staged with the same rows and leaves a manifest that exists as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonspark.operators.reshape import quoted
from canonspark.operators.topk import top_k_per_group
from canonspark.session import ensure_checkpoint_dir

RUN_SCHEMA = "file_name string, clean_date timestamp, cleaning_mode string, acceptance_ratio double, user_id long, clean_id string"


def _digest(rows: DataFrame) -> str:
    """A hash of a table's rows in any order: two sums of row hashes and their number."""
    row = [quoted(c).cast("string") for c in sorted(rows.columns)]
    seeds = [F.xxhash64(F.lit(seed), *[F.coalesce(c, F.lit("\u0000")) for c in row]).cast("decimal(20,0)") for seed in (1, 2)]
    got = rows.agg(*[F.sum(s) for s in seeds], F.count(F.lit(1))).first()
    return "/".join(map(str, got))


def _stage(summary: DataFrame, path: str, user_id: int, clean_id: str) -> None:
    rows = summary.withColumn("summary_id", F.sha2(F.concat_ws("\u0001", F.lit(clean_id), F.col("column")), 256))
    rows.write.mode("overwrite").parquet(f"{path}/summaries/user_id={user_id}/clean_id={clean_id}")


def _commit(overall: DataFrame, path: str, user_id: int, clean_id: str, file_name: str, cleaning_mode: str) -> None:
    run = overall.select(F.lit(file_name).alias("file_name"), F.current_timestamp().alias("clean_date"),
                         F.lit(cleaning_mode).alias("cleaning_mode"),
                         F.col("acceptance_ratio").cast("double").alias("acceptance_ratio"))
    # one row, one file; a manifest that exists stays
    run.coalesce(1).write.mode("ignore").parquet(f"{path}/cleans/user_id={user_id}/clean_id={clean_id}")


def save_run(path: str, user_id: int, file_name: str, cleaning_mode: str,
             overall: DataFrame, summary: DataFrame, run_key: str = "") -> str:
    """Save one run; ``overall`` is the one-row ``acceptance_ratio`` frame.  The same content
    is the same run; ``run_key`` tells runs apart that are meant to be several."""
    if not all([user_id, file_name, cleaning_mode]):
        raise ValueError("a run needs a user, a file name and a cleaning mode")     # P9, before any write
    user_id = int(user_id)
    ensure_checkpoint_dir(summary.sparkSession)
    summary = summary.checkpoint(eager=True)       # evaluated once for the check, the digest and the write
    overall = overall.checkpoint(eager=True)
    if summary.isEmpty():
        raise ValueError("a run needs at least one summary row")
    content = "\u0001".join([str(user_id), file_name, cleaning_mode, run_key, _digest(overall), _digest(summary)])
    clean_id = hashlib.sha256(content.encode()).hexdigest()[:32]
    _stage(summary, path, user_id, clean_id)
    _commit(overall, path, user_id, clean_id, file_name, cleaning_mode)
    return clean_id


def _runs(spark: SparkSession, path: str, user_id: int | None) -> DataFrame:
    cleans = spark.read.schema(RUN_SCHEMA).parquet(f"{path}/cleans")
    return cleans if user_id is None else cleans.where(F.col("user_id") == int(user_id))      # partition pruning


def _summaries(spark: SparkSession, path: str, user_id: int | None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/summaries").withColumns(
        {"user_id": F.col("user_id").cast("long"), "clean_id": F.col("clean_id").cast("string")})
    return rows if user_id is None else rows.where(F.col("user_id") == int(user_id))


def history(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """S8 + J7 (flat): every committed run of the user joined to its summary rows,
    newest first."""
    summaries = (_summaries(spark, path, user_id).drop("user_id")
                 .withColumnRenamed("acceptance_ratio", "summary_acceptance_ratio"))
    return (_runs(spark, path, user_id).join(summaries, "clean_id", "left")
            .orderBy(F.desc("clean_date"), "clean_id", "column"))


def run_details(spark: SparkSession, path: str, clean_id: str) -> DataFrame:
    """J7 (one run): the run's fields on each of its summary rows."""
    return history(spark, path).where(F.col("clean_id") == clean_id)


def nested_history(spark: SparkSession, path: str, user_id: int | None = None, most: int = 100) -> DataFrame:
    """J7 (nested): one row a run with ``n_summaries`` and ``summaries``, an array of its first
    ``most`` summary rows by column.  A run in category mode has as many summaries
    as categories, so the caller says how many a row may hold; ``run_details`` has all."""
    rows = _summaries(spark, path, user_id).drop("user_id")
    count = rows.groupBy("clean_id").agg(F.count(F.lit(1)).alias("n_summaries"))
    fields = [quoted(c) for c in rows.columns if c != "clean_id"]
    first = (top_k_per_group(rows, ["clean_id"], [F.col("column"), F.col("summary_id")], most, out="_place")
             .groupBy("clean_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("s")))),
                              lambda x: x["s"]).alias("summaries")))
    return (_runs(spark, path, user_id).join(count, "clean_id", "left").join(first, "clean_id", "left")
            .orderBy(F.desc("clean_date"), "clean_id"))
