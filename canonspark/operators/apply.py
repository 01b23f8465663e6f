"""Write the cleaned value of every cell.

A member's cleaned value is its cluster's suggestion unless a member
override (``overrides(group_key, cluster_id, member_idx, value)``) lists it;
an override whose value is NULL still wins (the flag is tested, not the
value).  Cells that are not members (NULL category, blank in direct mode)
keep their value.  The update is one left join on ``(row_id, col_name)``
instead of one scan per member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.operators import reshape as R
from canonspark.operators.suggest import last_entry


def resolve_members(members: DataFrame, suggestions: DataFrame,
                    overrides: DataFrame | None = None) -> DataFrame:
    """Members with ``cleaned`` and ``overridden``."""
    m = members.join(suggestions.select("group_key", "cluster_id", "suggestion"),
                     ["group_key", "cluster_id"], "left")
    if overrides is None:
        return m.withColumn("cleaned", F.col("suggestion")).withColumn("overridden", F.lit(False))
    o = last_entry(overrides, ["group_key", "cluster_id", "member_idx"], ["value"]).select(
        "group_key", "cluster_id", "member_idx", F.col("value").alias("_ov"), F.lit(True).alias("_hit"))
    return (m.join(o, ["group_key", "cluster_id", "member_idx"], "left")
            .withColumn("overridden", F.coalesce(F.col("_hit"), F.lit(False)))
            .withColumn("cleaned", F.when(F.col("overridden"), F.col("_ov")).otherwise(F.col("suggestion")))
            .drop("_ov", "_hit"))


def clean_long(long: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every non-null cell with its cleaned value."""
    r = resolved.select("row_id", "col_name", F.col("cleaned").alias("_cl"), F.lit(True).alias("_m"))
    return (long.join(r, ["row_id", "col_name"], "left")
            .withColumn("cleaned", F.when(F.col("_m"), F.col("_cl")).otherwise(F.col("value")))
            .drop("_cl", "_m"))


def cleaned_table(raw: DataFrame, long_cleaned: DataFrame, columns: list[str],
                  row_id: str = "row_id") -> DataFrame:
    """R2 + J4 + P12: the raw table with ``<col>_cleaned`` after each column."""
    wide = R.pivot_back(long_cleaned, columns)
    return R.attach_cleaned(raw, wide, columns, row_id)


def manual_corrections(resolved: DataFrame) -> DataFrame:
    """Overridden members per column."""
    return (resolved.groupBy(F.col("col_name").alias("group_key"))
            .agg(F.sum(F.col("overridden").cast("long")).alias("manual_corrections")))
