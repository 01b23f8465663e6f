"""One proposal per cluster.

* one member: the value itself, ``single_member``, confidence 1.0
* else the most frequent value (ties: first seen), ``majority``, n / size
* all members distinct: the first member that is a dictionary word
  (``spell_checker``, 1 / size), else the vote over spell-corrected members
  (first-seen tie, ``spell_checker``, 0.9)

Everything runs on the distinct-value table (``norm``, ``n`` occurrences,
first ``occ``) joined to its cluster; the member rows are never collected.
Confidence is rounded half-even to 2 places (``bround``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.functions import text as TX
from canonspark.operators import spell as SP
from canonspark.session import ensure_checkpoint_dir

# Suggestion modes and the confidence of a corrected vote
SINGLE = "single_member"
MAJORITY = "majority"
SPELL = "spell_checker"
CUSTOM = "custom"
KG = "google_kg"
LLM = "llm_suggest"
CORRECTED_CONFIDENCE = 0.9


def suggest(clustered: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``clustered(group_key, norm, occ, n, cluster_id, cluster_tag)`` ->
    ``group_key, cluster_id, cluster_tag, size, suggestion, suggestion_mode,
    original_suggestion_mode, confidence``."""
    c = clustered
    stats = (c.groupBy("group_key", "cluster_id", "cluster_tag")
             .agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("ndist"),
                  F.min_by(F.struct(F.col("norm").alias("v"), F.col("n").alias("k")),
                           F.struct((-F.col("n")).alias("nn"), F.col("occ").alias("o"))).alias("top")))
    alld = stats.where((F.col("ndist") == F.col("size")) & (F.col("size") > 1)) \
                .select("group_key", "cluster_id")
    # only the members of all-distinct clusters go through the dictionary path
    spell_members = c.join(alld, ["group_key", "cluster_id"], "left_semi")
    if dictionary is None:
        # no dictionary: no value is a known word and no word has a correction,
        # so the corrected phrase is the phrase with its words re-joined
        dict_pick = alld.withColumn("dict_word", F.lit(None).cast("string")).where(F.lit(False))
        corr = spell_members.select("norm").distinct().withColumn(
            "corrected", F.when(F.array_join(TX.words("norm"), " ") == "", F.col("norm"))
            .otherwise(F.array_join(TX.words("norm"), " ")))
    else:
        ensure_checkpoint_dir(c.sparkSession)
        spell_members = spell_members.checkpoint(eager=True)  # read three times
        flagged = SP.in_dictionary(spell_members, dictionary)
        dict_pick = (flagged.where("in_dict").groupBy("group_key", "cluster_id")
                     .agg(F.min_by("norm", "occ").alias("dict_word")))
        corr = SP.correct_phrases(spell_members.select("norm"), dictionary)
    voted = (spell_members.join(corr, "norm")
             .groupBy("group_key", "cluster_id", "corrected")
             .agg(F.count(F.lit(1)).alias("k"), F.min("occ").alias("o"))
             .groupBy("group_key", "cluster_id")
             .agg(F.min_by("corrected", F.struct((-F.col("k")).alias("nk"), "o")).alias("corr_vote")))
    s = (stats.join(dict_pick, ["group_key", "cluster_id"], "left")
         .join(voted, ["group_key", "cluster_id"], "left"))
    all_distinct = (F.col("ndist") == F.col("size")) & (F.col("size") > 1)
    suggestion = (F.when(F.col("size") == 1, F.col("top.v"))
                  .when(all_distinct & F.col("dict_word").isNotNull(), F.col("dict_word"))
                  .when(all_distinct, F.col("corr_vote"))
                  .otherwise(F.col("top.v")))
    mode = (F.when(F.col("size") == 1, F.lit(SINGLE))
            .when(all_distinct, F.lit(SPELL))
            .otherwise(F.lit(MAJORITY)))
    conf = (F.when(F.col("size") == 1, F.lit(1.0))
            .when(all_distinct & F.col("dict_word").isNotNull(), F.bround(F.lit(1.0) / F.col("size"), 2))
            .when(all_distinct, F.lit(CORRECTED_CONFIDENCE))
            .otherwise(F.bround(F.col("top.k") / F.col("size"), 2)))
    return s.select("group_key", "cluster_id", "cluster_tag", F.col("size").cast("long").alias("size"),
                    suggestion.alias("suggestion"), mode.alias("suggestion_mode"),
                    mode.alias("original_suggestion_mode"), conf.cast("double").alias("confidence"))


def last_entry(entries: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row for each key.  Of several entries the last counts: the highest
    ``entry`` if the table has that column, else the largest value (so that the
    result never depends on the physical order)."""
    order = [F.col(c) for c in ("entry", *values) if c in entries.columns]
    return (entries.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
            .select(*key, "_last.*"))


def apply_suggestion_overrides(suggestions: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace suggestion and mode of listed clusters (custom, google_kg,
    llm_suggest); ``original_suggestion_mode`` keeps the proposed mode.  Entries
    that repeat a cluster: see ``last_entry``."""
    if overrides is None:
        return suggestions
    o = last_entry(overrides, ["group_key", "cluster_id"], ["suggestion", "suggestion_mode"]).select(
        "group_key", "cluster_id", F.col("suggestion").alias("_os"),
        F.col("suggestion_mode").alias("_om"), F.lit(True).alias("_hit"))
    return (suggestions.join(o, ["group_key", "cluster_id"], "left")
            .withColumn("suggestion", F.when(F.col("_hit"), F.col("_os")).otherwise(F.col("suggestion")))
            .withColumn("suggestion_mode", F.when(F.col("_hit"), F.col("_om")).otherwise(F.col("suggestion_mode")))
            .drop("_os", "_om", "_hit"))


def value_map(clustered: DataFrame, suggestions: DataFrame) -> DataFrame:
    """``group_key, norm -> cluster_tag, suggestion``.  A value sits in
    one cluster here, so 'last assignment wins' is a plain join."""
    return (clustered.select("group_key", "norm", "cluster_id")
            .join(suggestions.select("group_key", "cluster_id", "cluster_tag", "suggestion"),
                  ["group_key", "cluster_id"])
            .select("group_key", "norm", "cluster_tag", "suggestion"))


def restore_case(suggestions: DataFrame, member_rows: DataFrame) -> DataFrame:
    """D17 option: replace a normalised suggestion by the most frequent raw
    spelling among the members that normalise to it (ties: first seen);
    suggestions that no member normalises to stay as they are."""
    raw = (member_rows.join(suggestions.select("group_key", "cluster_id", "suggestion"),
                            ["group_key", "cluster_id"])
           .where(F.col("norm") == F.col("suggestion"))
           .groupBy("group_key", "cluster_id", "value")
           .agg(F.count(F.lit(1)).alias("k"), F.min("occ").alias("o"))
           .groupBy("group_key", "cluster_id")
           .agg(F.min_by("value", F.struct((-F.col("k")).alias("nk"), "o")).alias("_raw")))
    return (suggestions.join(raw, ["group_key", "cluster_id"], "left")
            .withColumn("suggestion", F.coalesce("_raw", "suggestion")).drop("_raw"))
