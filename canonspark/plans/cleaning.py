"""The three cleaning pipelines as one Spark plan each.

``group_by_category`` (category mode) and ``group_in_column`` (direct mode)
differ only in the group key and the clustering rule:

    raw -> long -> norm -> distinct values -> edges -> labels -> clusters
        -> suggestions (+ members on demand)

``apply_cleaning`` then writes ``<col>_cleaned`` and the summary.  Nothing is
collected; every table stays a DataFrame keyed by ``group_key``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.functions import similarity as S
from canonspark.operators import apply as AP
from canonspark.operators import cluster as CL
from canonspark.operators import pairs as PR
from canonspark.operators import reshape as R
from canonspark.operators import suggest as SG
from canonspark.operators import summary as SM
from canonspark.operators.rank import row_number_within
from canonspark.plans.params import check_request

# Reference defaults
DEFAULT_THRESHOLD = 75
DEFAULT_SCORER = "ratio"
# scorers under which '' does not match '' (each empty occurrence stays alone)
EMPTY_NOT_SELF_SIMILAR = ("token_set_ratio", "partial_token_set_ratio", "QRatio", "WRatio")


@dataclass
class Grouping:
    mode: str                      # 'category' | 'direct'
    columns: list[str]
    raw: DataFrame
    long: DataFrame                # every non-null cell (incl. NULL categories, blanks)
    norm_long: DataFrame           # cells that take part in clustering
    nodes: DataFrame               # distinct values per group
    edges: DataFrame
    clustered: DataFrame           # nodes + leader, cluster_id, cluster_tag
    stats: DataFrame
    category: str | None = None
    dictionary: DataFrame | None = field(default=None, repr=False)
    occurrence_clusters: DataFrame | None = field(default=None, repr=False)   # exact mode
    values: DataFrame | None = field(default=None, repr=False)   # distinct raw values + norm
    _members: DataFrame | None = field(default=None, repr=False)
    _suggestions: DataFrame | None = field(default=None, repr=False)

    @property
    def suggestions(self) -> DataFrame:
        """G1, built on first use and checkpointed (apply and summary reuse it)."""
        if self._suggestions is None:
            self._suggestions = SG.suggest(self.clustered, self.dictionary).checkpoint(eager=True)
        return self._suggestions

    def members(self) -> DataFrame:
        """One row per member occurrence with its 0-based ``member_idx``."""
        if self._members is None:
            m = self.member_rows()
            self._members = row_number_within(m, ["group_key", "cluster_id"], ["occ"], "member_idx",
                                              start=0).checkpoint(eager=True)
        return self._members

    def restored_suggestions(self) -> DataFrame:
        """D17 option ``restore_case``: suggestions in their most frequent raw form."""
        return SG.restore_case(self.suggestions, self.member_rows())

    def member_rows(self) -> DataFrame:
        """Every clustered occurrence with its cluster (no index)."""
        if self.occurrence_clusters is not None:
            return self.norm_long.join(
                self.occurrence_clusters.select("group_key", "occ", "cluster_id", "cluster_tag"),
                ["group_key", "occ"])
        return self.norm_long.join(
            self.clustered.select("group_key", "norm", "cluster_id", "cluster_tag"), ["group_key", "norm"])

    def value_map(self) -> DataFrame:
        if self.occurrence_clusters is not None:
            # The last assignment of a value wins
            last = (self.occurrence_clusters.groupBy("group_key", "norm")
                    .agg(F.max_by("cluster_id", "occ").alias("cluster_id")))
            return SG.value_map(last, self.suggestions)
        return SG.value_map(self.clustered, self.suggestions)


def _cluster(mode: str, columns: list[str], raw: DataFrame, long: DataFrame, category: str | None,
             scorer: str, threshold: float, algorithm: str, dictionary: DataFrame | None,
             ml: bool, exact: bool = False) -> Grouping:
    S.check_scorer(scorer)                       # D14: before any job
    norm_long = R.normalise_long(long, mode)     # per cell; used only for member rows
    # one pass over the table: distinct raw values, normalised once each
    values = R.raw_values(long).checkpoint(eager=True)
    nodes = R.nodes_from_values(values, mode).checkpoint(eager=True)
    if ml:
        from canonspark.operators import kmeans as KM
        clustered = KM.kmeans_clusters(nodes, mode=mode)
        edges = nodes.sparkSession.createDataFrame([], "group_key string")
    elif exact:
        edges = PR.fuzzy_edges(nodes, scorer, threshold).checkpoint(eager=True)
        occ_clusters, clustered = CL.cluster_occurrences_exact(norm_long, edges)
        return Grouping(mode, columns, raw, long, norm_long, nodes, edges, clustered,
                        SM.value_stats_from_values(values), category, dictionary, occ_clusters, values)
    elif mode == "category" and scorer in EMPTY_NOT_SELF_SIMILAR:
        # D13: '' scores 0 against everything, itself included, so every ''
        # occurrence is a cluster of its own, numbered in occurrence order
        filled = nodes.where(F.col("norm") != "")
        edges = PR.fuzzy_edges(filled, scorer, threshold)
        assigned = CL.assign_leaders(filled, edges, algorithm)
        occ = (norm_long.where(F.col("norm") != "").select("group_key", "norm", "occ")
               .join(assigned.select("group_key", "norm", "leader"), ["group_key", "norm"])
               .unionByName(norm_long.where(F.col("norm") == "")
                            .select("group_key", "norm", "occ", F.col("occ").alias("leader"))))
        occ_clusters = CL.number_clusters(occ).checkpoint(eager=True)
        clustered = (occ_clusters.groupBy("group_key", "cluster_id", "cluster_tag", "norm")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("occ").alias("occ"))
                     .withColumn("leader", F.col("occ")).checkpoint(eager=True))
        return Grouping(mode, columns, raw, long, norm_long, nodes, edges, clustered,
                        SM.value_stats_from_values(values), category, dictionary, occ_clusters, values)
    else:
        edges = PR.fuzzy_edges(nodes, scorer, threshold)
        clustered = CL.cluster_values(nodes, edges, algorithm)
    stats = SM.value_stats_from_values(values)
    return Grouping(mode, columns, raw, long, norm_long, nodes, edges, clustered, stats, category,
                    dictionary, None, values)


def group_by_category(raw: DataFrame, columns: list[str], category: str,
                      scorer: str = DEFAULT_SCORER, threshold: float = DEFAULT_THRESHOLD,
                      dictionary: DataFrame | None = None, ml: bool = False,
                      row_id: str = "row_id") -> Grouping:
    """Cluster inside each category with leader clustering.

    Of the selected columns only short text takes part (P3-P5): numeric columns
    and columns with long texts are left as they are."""
    columns, scorer, threshold, ml = check_request(columns, scorer, threshold, ml)
    short = R.short_text_columns(raw, columns)
    if not short:
        raise ValueError("none of the selected columns holds short text")
    R.check_row_ids(raw, row_id)
    long = R.melt(raw, short, category=category, row_id=row_id)
    return _cluster("category", short, raw, long, category,
                    scorer, threshold, "leader", dictionary, ml)


def group_in_column(raw: DataFrame, columns: list[str],
                    scorer: str = DEFAULT_SCORER, threshold: float = DEFAULT_THRESHOLD,
                    dictionary: DataFrame | None = None, ml: bool = False,
                    row_id: str = "row_id", exact: bool = False) -> Grouping:
    """Cluster inside each column with first-fit clustering.

    ``exact=False`` (default at scale) clusters distinct values in first-seen
    order; ``exact=True`` clusters every occurrence as the row-by-row rule
    does, so equal values can end up in different clusters (D13)."""
    columns, scorer, threshold, ml = check_request(columns, scorer, threshold, ml)
    R.check_row_ids(raw, row_id)
    long = R.melt(raw, columns, category=None, row_id=row_id)
    return _cluster("direct", R.present_columns(raw, columns), raw, long, None,
                    scorer, threshold, "first_fit", dictionary, ml, exact)


@dataclass
class Applied:
    cleaned: DataFrame
    summary: DataFrame
    overall: DataFrame
    resolved: DataFrame
    # overridden members per column (A18); reported in both modes, while the
    # category-mode summary leaves manual_corrections NULL
    manual: DataFrame | None = None


def apply_cleaning(g: Grouping, member_overrides: DataFrame | None = None,
                   suggestion_overrides: DataFrame | None = None,
                   row_id: str = "row_id") -> Applied:
    """Overrides -> update -> widen -> summary -> overall ratio."""
    sugg = SG.apply_suggestion_overrides(g.suggestions, suggestion_overrides)
    if g.occurrence_clusters is None and g.values is not None:
        # the cleaned value depends on (group, raw value) except for members an
        # override addresses: a per-value map writes every cell, and member
        # indexes are computed only inside clusters that carry an override
        by_value = (g.values.where(R.keep_for_clustering(g.mode)).select("group_key", "value", "norm")
                    .join(g.clustered.select("group_key", "norm", "cluster_id"), ["group_key", "norm"]))
        vmap = (by_value.join(sugg.select("group_key", "cluster_id", "suggestion"), ["group_key", "cluster_id"])
                .select("group_key", "value", F.col("suggestion").alias("_cl"), F.lit(True).alias("_m")))
        patch, manual = None, None
        if member_overrides is not None:
            # overrides are read twice (touched clusters, then the patch join)
            ov = (SG.last_entry(member_overrides, ["group_key", "cluster_id", "member_idx"], ["value"])
                  .withColumnRenamed("value", "_ov").checkpoint(eager=True))
            touched = ov.select("group_key", "cluster_id").distinct()
            # cells of the touched clusters, found by raw value: nothing is normalised again
            m = (g.long.join(by_value.join(touched, ["group_key", "cluster_id"], "left_semi")
                             .select("group_key", "value", "cluster_id"), ["group_key", "value"])
                 .select("group_key", "cluster_id", "row_id", "col_name", F.struct("col_ord", "row_id").alias("occ")))
            ranked = row_number_within(m, ["group_key", "cluster_id"], ["occ"], "member_idx", start=0)
            patch = (ranked.join(ov, ["group_key", "cluster_id", "member_idx"])
                     .select("row_id", "col_name", "_ov").checkpoint(eager=True))
            manual = (patch.groupBy(F.col("col_name").alias("group_key"))
                      .agg(F.count(F.lit(1)).alias("manual_corrections")))
        cleaned = _apply_by_value(g, vmap, row_id, patch)
        summary = _summary(g, sugg, manual)
        return Applied(cleaned, summary, SM.overall_acceptance(summary), vmap, manual)
    if member_overrides is not None:
        members = g.members()
    else:
        # member indexes are only needed to address overrides
        members = g.member_rows()
    resolved = AP.resolve_members(members, sugg, member_overrides)
    long_cleaned = AP.clean_long(g.long, resolved)
    cleaned = AP.cleaned_table(g.raw, long_cleaned, g.columns, row_id)
    manual = AP.manual_corrections(resolved)
    summary = _summary(g, sugg, manual)
    return Applied(cleaned, summary, SM.overall_acceptance(summary), resolved, manual)


def _apply_by_value(g: Grouping, vmap: DataFrame, row_id: str,
                    patch: DataFrame | None = None) -> DataFrame:
    """Write ``<col>_cleaned`` straight onto the raw rows: one join per cleaned
    column with the per-value map (no melt, pivot or join back).  AQE turns
    each join into a broadcast when the map is small; beyond that it is a
    sort-merge join on (group, value).  ``patch(row_id, col_name, _ov)`` holds
    member overrides; an override wins even when its value is NULL."""
    out = g.raw
    if patch is not None:
        # one row for each patched row: its columns' values (at most one a column)
        rows = patch.groupBy(F.col("row_id").alias("_prow")).agg(F.map_from_entries(
            F.collect_list(F.struct("col_name", F.struct(F.col("_ov").alias("v"))))).alias("_patch"))
        out = out.join(rows, R.quoted(row_id) == F.col("_prow"), "left").drop("_prow")
    for i, c in enumerate(g.columns):
        m = vmap
        if g.mode == "direct":
            m = m.where(F.col("group_key") == c)
        m = m.select(F.col("group_key").alias(f"_g{i}"), F.col("value").alias(f"_v{i}"),
                     F.col("_cl").alias(f"_c{i}"), F.col("_m").alias(f"_m{i}"))
        key = R.quoted(c).cast("string")
        cond = key == F.col(f"_v{i}")
        if g.mode == "category":
            cond = cond & (R.quoted(g.category).cast("string") == F.col(f"_g{i}"))
        out = out.join(m, cond, "left")
        value = F.when(F.col(f"_m{i}"), F.col(f"_c{i}")).otherwise(key)
        if patch is not None:
            mine = F.col("_patch")[c]
            value = F.when(mine.isNotNull(), mine["v"]).otherwise(value)
        out = (out.withColumn(f"{c}_cleaned", value)
               .drop(f"_g{i}", f"_v{i}", f"_c{i}", f"_m{i}"))
    order = []
    for c in g.raw.columns:
        order.append(c)
        if c in g.columns:
            order.append(f"{c}_cleaned")
    return out.select(*[R.quoted(c) for c in order])


def _summary(g: Grouping, sugg: DataFrame, manual: DataFrame | None) -> DataFrame:
    if g.mode == "direct":
        groups = g.raw.sparkSession.createDataFrame([(c,) for c in g.columns], "group_key string")
        return SM.summarize(sugg, g.stats, "direct", groups=groups, manual=manual)
    src = g.values if g.values is not None else g.long
    groups = src.where(F.col("group_key").isNotNull()).select("group_key").distinct()
    return SM.summarize(sugg, g.stats, "category", groups=groups)
