"""Value statistics and the cleaning summary.

All counts are plain group-bys (partial aggregation before the shuffle);
the per-group summary joins the small per-group tables on ``group_key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.functions import text as T
from canonspark.operators import suggest as SG

# Modes counted as accepted and as replaced
ACCEPTED_MODES = (SG.MAJORITY, SG.SPELL, SG.SINGLE)
REJECTED_MODES = (SG.CUSTOM, SG.KG, SG.LLM)


def value_stats(long: DataFrame) -> DataFrame:
    """Per group, non-blank count and distinct raw values (as written,
    not stripped); blank and NULL values are left out."""
    kept = long.where(F.col("group_key").isNotNull() & (T.strip("value") != ""))
    return kept.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("total_values"),
        F.countDistinct("value").alias("num_of_before_unique"))


def value_stats_from_values(values: DataFrame) -> DataFrame:
    """A8/A9 from the distinct raw value table (one row per raw value)."""
    kept = values.where(F.col("group_key").isNotNull() & (T.strip("value") != ""))
    return kept.groupBy("group_key").agg(
        F.sum("n").alias("total_values"), F.count(F.lit(1)).alias("num_of_before_unique"))


def summarize(suggestions: DataFrame, stats: DataFrame, mode: str,
              groups: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Per-group summary.

    ``suggestions`` after overrides (G5); ``mode`` 'category' or 'direct'.
    Category mode skips clusters whose suggestion is NULL or '' (D10) and
    leaves ``manual_corrections`` NULL (D11); direct mode skips only NULL.
    ``groups`` lists groups that get a row even without clusters (direct mode:
    every cleaned column).
    """
    s = suggestions
    counted = F.col("suggestion").isNotNull()
    if mode == "category":
        counted = counted & (F.col("suggestion") != "")

    def members_of(m):
        return F.sum(F.when(counted & (F.col("suggestion_mode") == m), F.col("size")).otherwise(0))

    per = s.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("num_of_clusters"),
        F.countDistinct(F.when(counted, F.col("suggestion"))).alias("num_of_after_unique"),
        members_of(SG.MAJORITY).alias("num_of_majority"),
        members_of(SG.SINGLE).alias("total_num_of_single"),
        members_of(SG.SPELL).alias("num_of_spell_check"),
        members_of(SG.CUSTOM).alias("num_of_global_manual"),
        members_of(SG.KG).alias("num_of_gkg"),
        members_of(SG.LLM).alias("num_of_llm"),
    )
    if groups is not None:
        per = groups.select("group_key").join(per, "group_key", "left")
    out = per.join(stats, "group_key", "left")
    if manual is not None:
        out = out.join(manual, "group_key", "left")
    counts = ["num_of_clusters", "num_of_after_unique", "num_of_majority", "total_num_of_single",
              "num_of_spell_check", "num_of_global_manual", "num_of_gkg", "num_of_llm",
              "total_values", "num_of_before_unique"]
    for c in counts:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    accepted = F.col("num_of_majority") + F.col("num_of_spell_check") + F.col("total_num_of_single")
    rejected = F.col("num_of_global_manual") + F.col("num_of_gkg") + F.col("num_of_llm")
    ratio = F.when(accepted + rejected > 0,
                   F.bround(accepted / (accepted + rejected), 3) * F.lit(100.0)).otherwise(F.lit(0.0))
    if mode == "direct":
        manual_col = F.coalesce(F.col("manual_corrections"), F.lit(0)).cast("long") \
            if manual is not None else F.lit(0).cast("long")
    else:
        manual_col = F.lit(None).cast("long")
    return out.select(
        F.col("group_key").alias("column"), "total_values", "num_of_before_unique",
        "num_of_after_unique", manual_col.alias("manual_corrections"), "num_of_clusters",
        "num_of_majority", "total_num_of_single", "num_of_spell_check", "num_of_global_manual",
        "num_of_gkg", "num_of_llm", ratio.cast("double").alias("acceptance_ratio"))


def overall_acceptance(summary: DataFrame) -> DataFrame:
    """Unweighted mean of the group ratios, rounded to 3; 0 when empty."""
    return summary.agg(
        F.coalesce(F.bround(F.avg("acceptance_ratio"), 3), F.lit(0.0)).cast("double")
        .alias("acceptance_ratio"),
        F.count(F.lit(1)).alias("num_groups"))
