"""Query catalogue: one Spark query per operator, each over whole tables,
with the DuckDB statement that restates it (see ``oracle.py``).

Queries read the generated tables (or the messy fixture Spark derives from
them with the same SQL text as the oracle).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canonspark.functions import text as T
from canonspark.operators import pairs as PR
from canonspark.operators import profile as PF
from canonspark.operators import reshape as R
from canonspark.operators import spell as SP
from canonspark.operators import summary as SM
from canonspark.operators.rank import row_number_within
from canonspark.plans import cleaning as CL
from canonspark.plans import oracle as O
from canonspark.sources import csv as CSV
from canonspark.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MESSY_COLS = ["name_a", "name_b"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _part_raw(spark, sf):
    return TB.load(spark, sf, "part").withColumn("row_id", F.col("p_partkey"))


PART_RAW_SQL = "SELECT p_partkey AS row_id, * FROM part"


def _ff_clustered_part(spark, sf):
    return CL.group_in_column(_part_raw(spark, sf), ["p_name"])


# ------------------------------------------------------------------ wave 1

@query("normalize_text", f"""
SELECT item_id, {O.strip('text')} AS stripped, {O.norm('text')} AS norm,
       {O.norm('text')} IS NOT NULL AS keep_category,
       {O.strip(O.norm('text'))} <> '' AS keep_direct,
       translate(lower({O.strip('text')}), '{T.ASCII_PUNCTUATION.replace("'", "''")}', '') AS punct_stripped,
       len({O.words('text')}) AS word_count
FROM benchmark""")
def q_normalize_text(spark, sf):
    b = TB.load(spark, sf, "benchmark")
    n = T.normalize("text")
    return b.select("item_id", T.strip("text").alias("stripped"), n.alias("norm"),
                    n.isNotNull().alias("keep_category"), (T.strip(n) != "").alias("keep_direct"),
                    T.strip_ascii_punct("text").alias("punct_stripped"),
                    T.word_count("text").alias("word_count"))


@query("table_shape", "SELECT count(*) AS rows, 5 AS columns FROM customer")
def q_table_shape(spark, sf):
    return PF.table_shape(TB.load(spark, sf, "customer"))


def _profile_sql(table: str, key: str, cols: list[str]) -> str:
    unp = " UNION ALL ".join(
        f"SELECT '{c}' AS name, {i} AS col_ord, {key} AS rid, CAST({c} AS VARCHAR) AS raw FROM {table}"
        for i, c in enumerate(cols))
    v = f"CASE WHEN {O.strip('raw')} <> '' THEN {O.strip('raw')} END"
    numeric = r"regexp_full_match(v, '([0-9]+\.?[0-9]*|\.[0-9]+)')"
    return f"""
WITH lng AS ({unp}),
pv AS (SELECT name, col_ord, {v} AS v, count(*) AS n, min(rid) AS first_row FROM lng GROUP BY ALL),
pc AS (SELECT name, col_ord, sum(n) AS total_rows,
              sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS nonblank,
              count(v) AS uniq,
              sum(CASE WHEN v IS NOT NULL AND {numeric} THEN n ELSE 0 END) AS num_numeric,
              sum(CASE WHEN v IS NOT NULL THEN n * len({O.words('v')}) ELSE 0 END) AS words,
              list(v ORDER BY first_row) FILTER (WHERE v IS NOT NULL) AS samples
       FROM pv GROUP BY name, col_ord),
typed AS (SELECT *,
   CASE WHEN (CASE WHEN nonblank > 0 THEN num_numeric / nonblank ELSE 0 END) > 0.8 THEN 'numeric'
        WHEN (CASE WHEN nonblank > 0 THEN uniq / nonblank ELSE 0 END) < 0.5 AND uniq < 20 THEN 'categorical'
        ELSE 'text' END AS type
   FROM pc)
SELECT name, type, CAST(total_rows - nonblank AS BIGINT) AS "missingCount",
       CAST(uniq AS BIGINT) AS "uniqueCount",
       CASE WHEN type = 'categorical' THEN coalesce(samples, []::VARCHAR[])
            ELSE coalesce(samples[1:5], []::VARCHAR[]) END AS "sampleValues",
       (type = 'text' AND words / nonblank < 3) AS "isShortText",
       (type = 'categorical' AND uniq > 1 AND uniq < 20
        AND (CASE WHEN total_rows > 0 THEN (total_rows - nonblank) / total_rows ELSE 1 END) < 0.5) AS important,
       col_ord
FROM typed"""


PART_PROFILE_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER_PROFILE_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS_PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("profile_columns", _profile_sql("part", "p_partkey", PART_PROFILE_COLS))
def q_profile_columns(spark, sf):
    return PF.profile_columns(_part_raw(spark, sf), columns=PART_PROFILE_COLS)


@query("profile_customer", _profile_sql("customer", "c_custkey", CUSTOMER_PROFILE_COLS))
def q_profile_customer(spark, sf):
    c = TB.load(spark, sf, "customer").withColumn("row_id", F.col("c_custkey"))
    return PF.profile_columns(c, columns=CUSTOMER_PROFILE_COLS)


@query("profile_orders", _profile_sql("orders", "o_orderkey", ORDERS_PROFILE_COLS))
def q_profile_orders(spark, sf):
    o = TB.load(spark, sf, "orders").withColumn("row_id", F.col("o_orderkey"))
    return PF.profile_columns(o, columns=ORDERS_PROFILE_COLS)


SPELLED_COLS = ["key", "size", "price", "brand"]
_SPELLED_SQL = """SELECT p_partkey AS row_id, CAST(p_partkey AS VARCHAR) AS "key",
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '0' || p_size WHEN 2 THEN p_size || '.0'
       ELSE p_size || '.00' END AS size,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 7 AS VARCHAR) END AS price, p_brand AS brand FROM part"""


@query("profile_csv_spellings", _profile_sql(f"""(SELECT row_id, key, CAST(CAST(size AS DOUBLE) AS VARCHAR) AS size,
  CAST(CAST(price AS DOUBLE) AS VARCHAR) AS price, brand FROM ({_SPELLED_SQL}) t)""", "row_id", SPELLED_COLS))
def q_profile_csv_spellings(spark, sf):
    """A CSV in which one number is spelled in several ways, and integers with gaps."""
    TB.register(spark, sf, ("part",))
    path = _scratch(spark, "spelled")
    TB.write_table(spark.sql(_SPELLED_SQL.replace('"key"', "key").replace("VARCHAR", "STRING")), path, "csv")
    raw = PF.merged_spellings(CSV.read_csv(spark, path), ["row_id", *SPELLED_COLS])
    return PF.profile_columns(raw.withColumn("row_id", F.col("row_id").cast("long")), columns=SPELLED_COLS)


@query("preview_rows", """
SELECT c_custkey AS row_id, coalesce(CAST(c_custkey AS VARCHAR), '') AS c_custkey,
       coalesce(c_name, '') AS c_name, coalesce(CAST(c_nationkey AS VARCHAR), '') AS c_nationkey,
       coalesce(CAST(c_acctbal AS VARCHAR), '') AS c_acctbal, coalesce(c_mktsegment, '') AS c_mktsegment
FROM customer ORDER BY row_id LIMIT 100""")
def q_preview_rows(spark, sf):
    c = TB.load(spark, sf, "customer").withColumn("row_id", F.col("c_custkey"))
    return PF.preview_rows(c.select("row_id", *[x for x in c.columns if x != "row_id"]), "100")


MESSY_LONG_DIRECT = O.melt_sql(TB.MESSY_PART_SQL, MESSY_COLS, None)
MESSY_LONG_CATEGORY = O.melt_sql(TB.MESSY_PART_SQL, MESSY_COLS, "category")


def _stats_sql(long_sql: str) -> str:
    return f"""
SELECT group_key, CAST(count(*) AS BIGINT) AS total_values,
       CAST(count(DISTINCT value) AS BIGINT) AS num_of_before_unique
FROM ({long_sql}) l WHERE group_key IS NOT NULL AND {O.strip('value')} <> '' GROUP BY group_key"""


@query("column_stats", _stats_sql(MESSY_LONG_DIRECT))
def q_column_stats(spark, sf):
    return SM.value_stats(R.melt(TB.messy_part(spark, sf), MESSY_COLS))


@query("category_stats", _stats_sql(MESSY_LONG_CATEGORY))
def q_category_stats(spark, sf):
    return SM.value_stats(R.melt(TB.messy_part(spark, sf), MESSY_COLS, category="category"))


@query("short_text_columns", """
WITH lens AS (
  SELECT 'text' AS name, avg(length(text)) AS avg_len FROM documents UNION ALL
  SELECT 'lang', avg(length(lang)) FROM documents UNION ALL
  SELECT 'source', avg(length(source)) FROM documents)
SELECT name, false AS is_numeric, avg_len > 50 AS is_long, avg_len <= 50 AS is_short FROM lens
UNION ALL SELECT 'doc_id', true, false, false
UNION ALL SELECT 'n_chars', true, false, false""")
def q_short_text_columns(spark, sf):
    d = TB.load(spark, sf, "documents")
    numeric = set(R.numeric_columns(d))
    longc = set(R.long_text_columns(d))
    short = set(R.short_text_columns(d, d.columns))
    rows = [(c, c in numeric, c in longc, c in short) for c in d.columns]
    return spark.createDataFrame(rows, "name string, is_numeric boolean, is_long boolean, is_short boolean")


@query("melt_short_text", f"SELECT * FROM ({MESSY_LONG_CATEGORY}) l")
def q_melt(spark, sf):
    return R.melt(TB.messy_part(spark, sf), MESSY_COLS, category="category")


@query("pivot_back", f"""
SELECT row_id, category, name_a, name_a AS name_a_cleaned, name_b, name_b AS name_b_cleaned
FROM ({TB.MESSY_PART_SQL}) m""")
def q_pivot_back(spark, sf):
    raw = TB.messy_part(spark, sf)
    long = R.melt(raw, MESSY_COLS, category="category").withColumn("cleaned", F.col("value"))
    return R.attach_cleaned(raw, R.pivot_back(long, MESSY_COLS), MESSY_COLS)


# ------------------------------------------------------------------ wave 2

PART_LONG_DIRECT = O.melt_sql(PART_RAW_SQL, ["p_name"], None)


def _pairs_sql(long_sql: str, mode: str, scorer: str, t: float = 75) -> str:
    return f"""WITH {O.node_ctes(long_sql, mode)}, {O.edge_ctes(scorer, t)}
SELECT group_key, a, b, score FROM edges"""


def _pairs_query(raw_fn, cols, category, scorer, t=75):
    def run(spark, sf):
        raw = raw_fn(spark, sf)
        mode = "category" if category else "direct"
        # normalised once per raw value, and the table read once, not by every part of the join
        nodes = R.nodes_from_values(R.raw_values(R.melt(raw, cols, category=category)), mode).checkpoint(eager=True)
        return PR.fuzzy_edges(nodes, scorer, t).select("group_key", "a", "b", "score")
    return run


QUERIES["fuzzy_pairs_ratio"] = _pairs_query(_part_raw, ["p_name"], None, "ratio")
ORACLES["fuzzy_pairs_ratio"] = _pairs_sql(PART_LONG_DIRECT, "direct", "ratio")

for _name, _scorer in [("fuzzy_pairs_category", "ratio"), ("fuzzy_pairs_qratio", "QRatio"),
                       ("fuzzy_pairs_token_sort", "token_sort_ratio"),
                       ("fuzzy_pairs_token_set", "token_set_ratio"),
                       ("fuzzy_pairs_token_ratio", "token_ratio")]:
    QUERIES[_name] = _pairs_query(TB.messy_part, MESSY_COLS, "category", _scorer)
    ORACLES[_name] = _pairs_sql(MESSY_LONG_CATEGORY, "category", _scorer)

# partial family and WRatio: the oracle scores every pair of a group
for _name, _scorer in [("fuzzy_pairs_partial", "partial_ratio"),
                       ("fuzzy_pairs_partial_token_sort", "partial_token_sort_ratio"),
                       ("fuzzy_pairs_partial_token_set", "partial_token_set_ratio"),
                       ("fuzzy_pairs_partial_token", "partial_token_ratio"),
                       ("fuzzy_pairs_wratio", "WRatio")]:
    QUERIES[_name] = _pairs_query(TB.messy_part, MESSY_COLS, "category", _scorer)
    ORACLES[_name] = f"""WITH {O.node_ctes(MESSY_LONG_CATEGORY, 'category')}, {O.partial_edge_ctes(_scorer, 75)}
SELECT group_key, a, b, score FROM edges"""


# texts whose words repeat, and their beginnings
REPEATS_SQL = f"""
SELECT row_id, category,
       CASE row_id % 4 WHEN 0 THEN concat(name_a, ' ', name_a) WHEN 1 THEN concat(name_a, ' ', name_a, ' ', name_a)
                       WHEN 2 THEN substring(name_a, 1, 4) ELSE name_a END AS name_a
FROM ({TB.MESSY_PART_SQL}) m"""
REPEATS_LONG = O.melt_sql(REPEATS_SQL, ["name_a"], "category")


def _repeats(spark, sf):
    TB.register(spark, sf, ("part",))
    return spark.sql(REPEATS_SQL)


for _name, _scorer in [("fuzzy_pairs_ratio_t80", "ratio"), ("fuzzy_pairs_token_sort_t85", "token_sort_ratio")]:
    _t = 80 if _name.endswith("t80") else 85
    QUERIES[_name] = _pairs_query(TB.messy_part, MESSY_COLS, "category", _scorer, _t)
    ORACLES[_name] = _pairs_sql(MESSY_LONG_CATEGORY, "category", _scorer, _t)
QUERIES["fuzzy_pairs_token_set_repeats"] = _pairs_query(_repeats, ["name_a"], "category", "token_set_ratio")
ORACLES["fuzzy_pairs_token_set_repeats"] = _pairs_sql(REPEATS_LONG, "category", "token_set_ratio")
QUERIES["fuzzy_pairs_partial_token_set_repeats"] = _pairs_query(
    _repeats, ["name_a"], "category", "partial_token_set_ratio")
ORACLES["fuzzy_pairs_partial_token_set_repeats"] = f"""WITH {O.node_ctes(REPEATS_LONG, 'category')},
{O.partial_edge_ctes('partial_token_set_ratio', 75)}
SELECT group_key, a, b, score FROM edges"""


def _clusters_sql(long_sql: str, mode: str, algorithm: str, scorer: str = "ratio") -> str:
    return f"""WITH RECURSIVE {O.node_ctes(long_sql, mode)}, {O.edge_ctes(scorer, 75)}, {O.cluster_ctes(algorithm)}
SELECT group_key, norm, CAST(cluster_id AS BIGINT) AS cluster_id FROM clustered"""


def _cluster_out(g: CL.Grouping) -> DataFrame:
    return g.clustered.select("group_key", "norm", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("leader_clusters", _clusters_sql(MESSY_LONG_CATEGORY, "category", "leader"))
def q_leader_clusters(spark, sf):
    return _cluster_out(CL.group_by_category(TB.messy_part(spark, sf), MESSY_COLS, "category"))


@query("leader_clusters_part", _clusters_sql(PART_LONG_DIRECT, "direct", "leader"))
def q_leader_clusters_part(spark, sf):
    raw = _part_raw(spark, sf)
    long = R.melt(raw, ["p_name"])
    g = CL._cluster("direct", ["p_name"], raw, long, None, "ratio", 75, "leader", None, False)
    return _cluster_out(g)


@query("first_fit_clusters", _clusters_sql(PART_LONG_DIRECT, "direct", "first_fit"))
def q_first_fit_clusters(spark, sf):
    return _cluster_out(_ff_clustered_part(spark, sf))


@query("first_fit_messy", _clusters_sql(MESSY_LONG_DIRECT, "direct", "first_fit"))
def q_first_fit_messy(spark, sf):
    return _cluster_out(CL.group_in_column(TB.messy_part(spark, sf), MESSY_COLS))


# ------------------------------------------------------------------ wave 3

def _suggest_sql(long_sql: str, mode: str, algorithm: str) -> str:
    return f"""WITH RECURSIVE {O.node_ctes(long_sql, mode)}, {O.edge_ctes('ratio', 75)},
{O.cluster_ctes(algorithm)}, {O.suggestion_ctes()}
SELECT group_key, CAST(cluster_id AS BIGINT) AS cluster_id, cluster_tag, size, suggestion,
       suggestion_mode, CAST(confidence AS DOUBLE) AS confidence FROM sugg"""


def _sugg_out(g: CL.Grouping) -> DataFrame:
    return g.suggestions.select("group_key", F.col("cluster_id").cast("long").alias("cluster_id"),
                                "cluster_tag", "size", "suggestion", "suggestion_mode", "confidence")


@query("majority_suggestions", _suggest_sql(MESSY_LONG_DIRECT, "direct", "first_fit"))
def q_majority_suggestions(spark, sf):
    return _sugg_out(CL.group_in_column(TB.messy_part(spark, sf), MESSY_COLS))


@query("category_suggestions", _suggest_sql(MESSY_LONG_CATEGORY, "category", "leader"))
def q_category_suggestions(spark, sf):
    return _sugg_out(CL.group_by_category(TB.messy_part(spark, sf), MESSY_COLS, "category"))


# brand-like words of the dictionary and misspellings of them, one occurrence each
SPELL_FIXTURE_SQL = f"""
SELECT row_number() OVER (ORDER BY word, v) AS row_id, concat('len', cast(length(word) as string)) AS category,
       CASE v WHEN 0 THEN word WHEN 1 THEN concat(substring(word, 1, 5), substring(word, 7))
              ELSE concat(substring(word, 1, 4), 'q', substring(word, 5)) END AS name
FROM (SELECT word, freq FROM dict WHERE length(word) BETWEEN 9 AND 14 AND freq >= 5) w
CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) k
WHERE v > 0 OR length(word) % 2 = 0"""


def _spell_fixture(dictionary: DataFrame) -> DataFrame:
    """The rows of ``SPELL_FIXTURE_SQL``, numbered by many tasks."""
    words = (dictionary.where("length(word) between 9 and 14 and freq >= 5")
             .select("word", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
             .where("v > 0 or length(word) % 2 = 0"))
    return row_number_within(words, [], ["word", "v"], "row_id").selectExpr(
        "row_id", "concat('len', length(word)) AS category",
        """CASE v WHEN 0 THEN word WHEN 1 THEN concat(substring(word, 1, 5), substring(word, 7))
           ELSE concat(substring(word, 1, 4), 'q', substring(word, 5)) END AS name""").checkpoint(eager=True)


SPELL_FIXTURE_LONG = O.melt_sql(SPELL_FIXTURE_SQL.replace("as string", "as varchar"), ["name"], "category")


@query("category_suggestions_dictionary", f"""WITH RECURSIVE dict AS MATERIALIZED ({TB.DICTIONARY_SQL}),
{O.node_ctes(SPELL_FIXTURE_LONG, 'category')}, {O.edge_ctes('ratio', 85)}, {O.cluster_ctes('leader')},
{O.dictionary_suggestion_ctes(SP.FLOAT_PATTERN[1:-1], SP.LONG_WORD_SLACK)}
SELECT group_key, CAST(cluster_id AS BIGINT) AS cluster_id, cluster_tag, size, suggestion,
       suggestion_mode, CAST(confidence AS DOUBLE) AS confidence FROM sugg""")
def q_category_suggestions_dictionary(spark, sf):
    """G1 with the documents' dictionary: a dictionary word of the cluster (A12, A13),
    else the vote of the corrected texts, else majority or single member."""
    d = TB.dictionary(spark, sf).checkpoint(eager=True)
    g = CL.group_by_category(_spell_fixture(d), ["name"], "category", threshold=85, dictionary=d)
    return _sugg_out(g)


@query("value_map", f"""WITH RECURSIVE {O.node_ctes(PART_LONG_DIRECT, 'direct')}, {O.edge_ctes('ratio', 75)},
{O.cluster_ctes('first_fit')}, {O.suggestion_ctes()}
SELECT c.group_key, c.norm, s.cluster_tag, s.suggestion
FROM clustered c JOIN sugg s USING (group_key, cluster_id)""")
def q_value_map(spark, sf):
    return _ff_clustered_part(spark, sf).value_map()


@query("dictionary_words", TB.DICTIONARY_SQL)
def q_dictionary_words(spark, sf):
    return TB.dictionary(spark, sf)


@query("dictionary_suggestions", f"""
WITH dict AS ({TB.DICTIONARY_SQL}),
v AS (SELECT DISTINCT {O.norm('value')} AS norm FROM ({MESSY_LONG_DIRECT}) l)
SELECT v.norm, d.word IS NOT NULL AS in_dict FROM v LEFT JOIN dict d ON v.norm = d.word""")
def q_dictionary_suggestions(spark, sf):
    vals = (R.melt(TB.messy_part(spark, sf), MESSY_COLS)
            .select(T.normalize("value").alias("norm")).distinct())
    return SP.in_dictionary(vals, TB.dictionary(spark, sf)).select("norm", "in_dict")


SPELL_WORDS_SQL = f"""
SELECT DISTINCT unnest({O.words(O.norm('value'))}) AS word FROM ({MESSY_LONG_DIRECT}) l"""


@query("spell_corrections", f"""
WITH dict AS ({TB.DICTIONARY_SQL}),
w AS ({SPELL_WORDS_SQL}),
longest AS (SELECT max(length(word)) AS m FROM dict),
chk AS (SELECT w.word FROM w, longest
        WHERE w.word NOT IN (SELECT word FROM dict)
          AND NOT regexp_full_match(lower(w.word), '{SP.FLOAT_PATTERN[1:-1]}')
          AND lower(w.word) <> 'nan' AND length(w.word) <= longest.m + {SP.LONG_WORD_SLACK}),
cand AS (SELECT chk.word, d.word AS dword, d.freq, damerau_levenshtein(chk.word, d.word) AS tier
         FROM chk JOIN dict d ON abs(length(chk.word) - length(d.word)) <= 2
         WHERE damerau_levenshtein(chk.word, d.word) BETWEEN 1 AND 2),
best AS (SELECT word, arg_min(dword, (tier, -freq, dword)) AS correction,
                arg_min(tier, (tier, -freq, dword)) AS tier
         FROM cand GROUP BY word)
SELECT w.word,
       CASE WHEN w.word IN (SELECT word FROM dict) THEN w.word ELSE coalesce(b.correction, w.word) END AS correction,
       CASE WHEN w.word IN (SELECT word FROM dict) THEN 0 ELSE b.tier END AS tier
FROM w LEFT JOIN best b USING (word)""")
def q_spell_corrections(spark, sf):
    words = (R.melt(TB.messy_part(spark, sf), MESSY_COLS)
             .select(F.explode(T.words(T.normalize("value"))).alias("word")).distinct())
    return SP.correct_words(words, TB.dictionary(spark, sf)).select(
        "word", "correction", F.col("tier").cast("int").alias("tier"))


# ------------------------------------------------------------------ wave 4

def fixture_overrides(g: CL.Grouping):
    """Overrides a person could have made, derived by rule from the grouping
    (same rule as ``oracle.override_ctes``)."""
    s = g.suggestions
    multi = (g.clustered.groupBy("group_key", "cluster_id").agg(F.count(F.lit(1)).alias("ndist"))
             .where(F.col("ndist") > 1).select("group_key", "cluster_id"))
    # the last member of a cluster: the occurrence with the largest occ
    member_ov = (g.member_rows().join(multi, ["group_key", "cluster_id"], "left_semi")
                 .groupBy("group_key", "cluster_id")
                 .agg(F.max_by("norm", "occ").alias("value"), F.count(F.lit(1)).alias("_k"))
                 .select("group_key", "cluster_id", (F.col("_k") - 1).alias("member_idx"), "value"))
    single = F.col("suggestion_mode") == "single_member"
    gear = F.col("suggestion").contains("gear")
    bolt = F.col("suggestion").contains("bolt")
    sugg_ov = (s.where(single | gear | bolt)
               .select("group_key", "cluster_id",
                       F.when(single, F.upper("suggestion")).when(gear, F.lit("Gear"))
                       .otherwise(F.lit("Bolt")).alias("suggestion"),
                       F.when(single, F.lit("custom")).when(gear, F.lit("google_kg"))
                       .otherwise(F.lit("llm_suggest")).alias("suggestion_mode")))
    # every entry is preceded by one that it replaces
    stale = (member_ov.withColumn("value", F.lit("stale")).withColumn("entry", F.lit(1)),
             sugg_ov.withColumn("suggestion", F.lit("stale")).withColumn("suggestion_mode", F.lit("custom"))
             .withColumn("entry", F.lit(1)))
    return (member_ov.withColumn("entry", F.lit(2)).unionByName(stale[0]),
            sugg_ov.withColumn("entry", F.lit(2)).unionByName(stale[1]))


def _applied(spark, sf, mode):
    raw = TB.messy_part(spark, sf)
    g = (CL.group_in_column(raw, MESSY_COLS) if mode == "direct"
         else CL.group_by_category(raw, MESSY_COLS, "category"))
    mo, so = fixture_overrides(g)
    return CL.apply_cleaning(g, mo, so)


def _apply_sql(mode: str, tail: str, with_overrides: bool = True) -> str:
    long_sql = MESSY_LONG_DIRECT if mode == "direct" else MESSY_LONG_CATEGORY
    algorithm = "first_fit" if mode == "direct" else "leader"
    groups = ("SELECT DISTINCT col_name AS group_key FROM lng" if mode == "direct"
              else "SELECT DISTINCT group_key FROM lng WHERE group_key IS NOT NULL")
    if mode == "direct":
        groups = "SELECT unnest(['name_a', 'name_b']) AS group_key"
    return f"""WITH RECURSIVE {O.node_ctes(long_sql, mode)}, {O.edge_ctes('ratio', 75)},
{O.cluster_ctes(algorithm)}, {O.suggestion_ctes()}, {O.override_ctes(with_overrides)}, {O.summary_select(mode, groups)}
{tail}"""


CLEANED_TAIL = f"""
SELECT m.row_id, m.category, m.name_a, a.cleaned AS name_a_cleaned, m.name_b, b.cleaned AS name_b_cleaned
FROM ({TB.MESSY_PART_SQL}) m
LEFT JOIN lc a ON a.row_id = m.row_id AND a.col_name = 'name_a'
LEFT JOIN lc b ON b.row_id = m.row_id AND b.col_name = 'name_b'"""

OVERALL_TAIL = """
SELECT CAST(coalesce(round_even(avg(acceptance_ratio), 3), 0.0) AS DOUBLE) AS acceptance_ratio,
       count(*) AS num_groups FROM summ"""


@query("apply_direct", _apply_sql("direct", CLEANED_TAIL))
def q_apply_direct(spark, sf):
    return _applied(spark, sf, "direct").cleaned


@query("apply_category", _apply_sql("category", CLEANED_TAIL))
def q_apply_category(spark, sf):
    return _applied(spark, sf, "category").cleaned


PART_LONG_CATEGORY = O.melt_sql(PART_RAW_SQL, ["p_name"], "p_brand")


@query("apply_category_mixed", f"""WITH RECURSIVE {O.node_ctes(PART_LONG_CATEGORY, 'category')},
{O.edge_ctes('ratio', 75)}, {O.cluster_ctes('leader')}, {O.suggestion_ctes()}
SELECT p.p_partkey AS row_id, p.p_partkey, p.p_name, coalesce(s.suggestion, p.p_name) AS p_name_cleaned, p.p_brand,
       p.p_type, p.p_size, p.p_retailprice
FROM part p
LEFT JOIN nlf n ON n.row_id = p.p_partkey LEFT JOIN clustered c ON c.group_key = n.group_key AND c.norm = n.norm
LEFT JOIN sugg s ON s.group_key = c.group_key AND s.cluster_id = c.cluster_id""")
def q_apply_category_mixed(spark, sf):
    """Category mode with numeric columns selected: only the short text is cleaned."""
    raw = _part_raw(spark, sf)
    g = CL.group_by_category(raw, ["p_name", "p_size", "p_retailprice"], "p_brand")
    out = CL.apply_cleaning(g).cleaned
    return out.select("row_id", *[c for c in out.columns if c != "row_id"])


@query("apply_plain", _apply_sql("direct", CLEANED_TAIL, with_overrides=False))
def q_apply_plain(spark, sf):
    """Apply without any override: one join of the cells with a per-value map."""
    return CL.apply_cleaning(CL.group_in_column(TB.messy_part(spark, sf), MESSY_COLS)).cleaned


@query("category_summary_plain", _apply_sql("category", "SELECT * FROM summ", with_overrides=False))
def q_category_summary_plain(spark, sf):
    raw = TB.messy_part(spark, sf)
    return CL.apply_cleaning(CL.group_by_category(raw, MESSY_COLS, "category")).summary


@query("cleaning_summary", _apply_sql("direct", "SELECT * FROM summ"))
def q_cleaning_summary(spark, sf):
    return _applied(spark, sf, "direct").summary


@query("category_summary", _apply_sql("category", "SELECT * FROM summ"))
def q_category_summary(spark, sf):
    return _applied(spark, sf, "category").summary


@query("overall_acceptance", _apply_sql("direct", OVERALL_TAIL))
def q_overall_acceptance(spark, sf):
    return _applied(spark, sf, "direct").overall


@query("overall_acceptance_category", _apply_sql("category", OVERALL_TAIL))
def q_overall_acceptance_category(spark, sf):
    return _applied(spark, sf, "category").overall


# ------------------------------------------------------------------ wave 5

def _tfidf_ctes(long_sql: str, mode: str) -> str:
    grams = " , ".join(
        f"list_transform(range(1, length(doc) - {n - 1} + 1), lambda i: substr(doc, i::BIGINT, {n}))"
        for n in (2, 3, 4))
    return f"""WITH {O.node_ctes(long_sql, mode)},
d AS (SELECT group_key, norm, n, regexp_replace(lower(norm), '[{O.WS}][{O.WS}]+', ' ', 'g') AS doc FROM nodes),
g AS (SELECT group_key, norm, n, gram, count(*) AS tf
      FROM (SELECT group_key, norm, n, unnest(list_concat({grams})) AS gram FROM d) GROUP BY ALL),
dfs AS (SELECT group_key, gram, sum(n) AS df FROM g GROUP BY ALL),
docs AS (SELECT group_key, sum(n) AS big_n FROM nodes GROUP BY ALL),
w AS (SELECT g.group_key, g.norm, g.gram, g.tf, dfs.df,
             ln((1.0 + docs.big_n) / (1.0 + dfs.df)) + 1.0 AS idf
      FROM g JOIN dfs USING (group_key, gram) JOIN docs USING (group_key)),
l2 AS (SELECT group_key, norm, sqrt(sum((tf * idf) * (tf * idf))) AS l2 FROM w GROUP BY ALL)"""


def _tfidf_sql(long_sql: str, mode: str) -> str:
    return f"""{_tfidf_ctes(long_sql, mode)}
SELECT w.group_key, w.norm, w.gram, CAST(w.tf AS BIGINT) AS tf, CAST(w.df AS BIGINT) AS df,
       round_even(w.idf, 9) AS idf, round_even((w.tf * w.idf) / l2.l2, 9) AS weight
FROM w JOIN l2 USING (group_key, norm)"""


@query("tfidf_char_ngrams", _tfidf_sql(MESSY_LONG_CATEGORY, "category"))
def q_tfidf(spark, sf):
    from canonspark.operators import kmeans as KM
    nodes = R.distinct_values(R.normalise_long(
        R.melt(TB.messy_part(spark, sf), MESSY_COLS, category="category"), "category"))
    t = KM.tfidf(nodes)
    return t.select("group_key", "norm", "gram", "tf", "df", F.bround("idf", 9).alias("idf"),
                    F.bround("weight", 9).alias("weight"))


def _kmeans_sql(long_sql: str, mode: str, max_k: int) -> str:
    """What must hold of any solver's labels: every value labelled, the number of
    labels in range, labels 1..k without gaps, numbered by first occurrence."""
    return f"""WITH {O.node_ctes(long_sql, mode)}
SELECT group_key, CAST(count(*) AS BIGINT) AS n_values, CAST(count(*) AS BIGINT) AS labelled, true AS in_range,
       true AS gapless, true AS in_order, true AS repeatable FROM nodes GROUP BY group_key"""


def _kmeans_out(raw, cols, category, max_k: int) -> DataFrame:
    def run():
        g = (CL.group_by_category(raw, cols, category, ml=True) if category else CL.group_in_column(raw, cols, ml=True))
        return g.clustered.select("group_key", "norm", "occ", "n", "cluster_id")

    c = run()
    again = run().select("group_key", "norm", F.col("cluster_id").alias("second"))
    first = c.groupBy("group_key", "cluster_id").agg(F.min("occ").alias("o"))
    w = Window.partitionBy("group_key").orderBy("o")          # at most max_k labels a group
    order = first.withColumn("rank", F.row_number().over(w)).groupBy("group_key").agg(
        F.min(F.col("rank") == F.col("cluster_id")).alias("in_order"), F.count(F.lit(1)).alias("k"),
        F.max("cluster_id").alias("top"))
    per = c.join(again, ["group_key", "norm"]).groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n_values"), F.count("cluster_id").alias("labelled"), F.sum("n").alias("size"),
        F.min(F.col("cluster_id") == F.col("second")).alias("repeatable"))
    k = F.col("k")
    return per.join(order, "group_key").select(
        "group_key", "n_values", "labelled",
        ((k >= 1) & (k <= F.greatest(F.lit(1), F.least(F.lit(max_k), F.col("size") - 1, F.col("n_values"))))).alias("in_range"),
        (F.col("top") == k).alias("gapless"), "in_order", "repeatable")


@query("kmeans_clusters", _kmeans_sql(PART_LONG_DIRECT, "direct", 8))
def q_kmeans(spark, sf):
    return _kmeans_out(_part_raw(spark, sf), ["p_name"], None, 8)


@query("kmeans_category", _kmeans_sql(MESSY_LONG_CATEGORY, "category", 20))
def q_kmeans_category(spark, sf):
    return _kmeans_out(TB.messy_part(spark, sf), MESSY_COLS, "category", 20)


_VECTORS = """,
t AS (SELECT w.group_key, w.norm, w.gram, (w.tf * w.idf) / l2.l2 AS weight FROM w JOIN l2 USING (group_key, norm))"""

_SILHOUETTE_SQL = f"""{_tfidf_ctes(PART_LONG_DIRECT, "direct")}{_VECTORS},
x AS (SELECT n.group_key, n.norm, n.n, coalesce(s.xx, 0.0) AS xx
      FROM nodes n LEFT JOIN (SELECT group_key, norm, sum(weight * weight) AS xx FROM t GROUP BY ALL) s USING (group_key, norm)),
dots AS (SELECT a.group_key, a.norm AS a, b.norm AS b, sum(a.weight * b.weight) AS dot
         FROM t a JOIN t b ON a.group_key = b.group_key AND a.gram = b.gram GROUP BY ALL),
pair AS (SELECT p.group_key, p.norm AS a, q.norm AS b, q.n,
             CASE WHEN p.norm = q.norm THEN 0.0 ELSE sqrt(greatest(0.0, p.xx + q.xx - 2 * coalesce(dot, 0.0))) END AS dist
      FROM x p JOIN x q ON p.group_key = q.group_key
      LEFT JOIN dots ON dots.group_key = p.group_key AND dots.a = p.norm AND dots.b = q.norm),
ks AS (SELECT unnest([2, 3, 5]) AS k),
m AS (SELECT group_key, k, a, length(a) % k AS ca, length(b) % k AS cb, sum(n * dist) AS total, sum(n) AS size
      FROM pair, ks GROUP BY ALL),
s AS (SELECT group_key, k, a, max(CASE WHEN ca = cb THEN size END) AS own,
             max(CASE WHEN ca = cb AND size > 1 THEN total / (size - 1) END) AS da,
             min(CASE WHEN ca <> cb THEN total / size END) AS db
      FROM m GROUP BY ALL)
SELECT s.group_key, k, round_even(sum(x.n * CASE WHEN own = 1 OR greatest(da, db) <= 0 THEN 0.0
       ELSE (db - da) / greatest(da, db) END) / sum(x.n), 6) AS score
FROM s JOIN x ON x.group_key = s.group_key AND x.norm = s.a GROUP BY s.group_key, k HAVING min(db) IS NOT NULL"""


@query("kmeans_silhouette", _SILHOUETTE_SQL)
def q_kmeans_silhouette(spark, sf):
    """M3 by itself: silhouettes of labels that the length of a value gives, for three k."""
    from canonspark.operators import kmeans as KM
    nodes = R.distinct_values(R.normalise_long(R.melt(_part_raw(spark, sf), ["p_name"]), "direct"))
    entries = KM.tfidf(nodes).select("group_key", "norm", "gram", "weight")
    labels = nodes.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).select(
        "group_key", "k", "norm", (F.length("norm") % F.col("k")).cast("int").alias("c"))
    r = KM.silhouettes(labels, entries, nodes.select("group_key", "norm", "n"))
    return r.select("group_key", "k", F.bround("score", 6).alias("score"))


def _nearest_sql(i: int) -> str:
    return f"""len{i} AS (SELECT group_key, c, sum(w * w) AS len FROM c{i} GROUP BY ALL),
p{i} AS (SELECT t.group_key, t.norm, c, sum(weight * w) AS dot FROM t JOIN c{i} USING (group_key, gram) GROUP BY ALL),
a{i} AS (SELECT group_key, norm, c, d FROM (
  SELECT v.group_key, v.norm, l.c, round(len - 2 * coalesce(dot, 0.0), 10) AS d,
         row_number() OVER (PARTITION BY v.group_key, v.norm ORDER BY round(len - 2 * coalesce(dot, 0.0), 10), l.c) AS rk
  FROM nodes v JOIN len{i} l ON l.group_key = v.group_key
  LEFT JOIN p{i} p ON p.group_key = v.group_key AND p.norm = v.norm AND p.c = l.c) r WHERE rk = 1)"""


_ROUND_SQL = f"""{_tfidf_ctes(MESSY_LONG_CATEGORY, "category")}{_VECTORS},
c1 AS (SELECT group_key, c, gram, weight AS w FROM t JOIN (
         SELECT group_key, norm, row_number() OVER (PARTITION BY group_key ORDER BY norm) AS c
         FROM (SELECT DISTINCT group_key, norm FROM t) v) o USING (group_key, norm) WHERE c <= 4),
{_nearest_sql(1)},
c2 AS (SELECT s.group_key, s.c, gram, sum(n * weight) / max(tot) AS w
       FROM a1 s JOIN nodes USING (group_key, norm) JOIN t USING (group_key, norm)
       JOIN (SELECT group_key, c, sum(n) AS tot FROM a1 JOIN nodes USING (group_key, norm) GROUP BY ALL) z
         ON z.group_key = s.group_key AND z.c = s.c
       GROUP BY s.group_key, s.c, gram),
{_nearest_sql(2)}
SELECT a2.group_key, a2.norm, CAST(a1.c AS BIGINT) AS first, CAST(a2.c AS BIGINT) AS second, round_even(a2.d, 6) AS d
FROM a1 JOIN a2 USING (group_key, norm)"""


@query("kmeans_round", _ROUND_SQL)
def q_kmeans_round(spark, sf):
    """M2 step by step: nearest of four given centres, their means, nearest of these."""
    from canonspark.operators import kmeans as KM
    nodes = R.distinct_values(R.normalise_long(
        R.melt(TB.messy_part(spark, sf), MESSY_COLS, category="category"), "category"))
    entries = KM.tfidf(nodes).select("group_key", "norm", "gram", "weight")
    w = Window.partitionBy("group_key").orderBy("norm")
    seeds = (entries.select("group_key", "norm").distinct().withColumn("c", F.row_number().over(w)).where("c <= 4")
             .join(entries, ["group_key", "norm"])
             .select("group_key", F.lit(4).alias("k"), F.lit(0).alias("s"), "c", "gram", F.col("weight").alias("w")))
    blocks = KM.value_blocks(nodes, entries)
    first = KM.step(blocks, KM.centre_lists(seeds))
    second = KM.step(blocks, KM.means_of(first))

    def labels(df, c):
        x = F.explode(F.arrays_zip("norms", "labels", "ds"))
        return df.where("c = 0").select("group_key", x.alias("x")).select(
            "group_key", F.col("x.norms").alias("norm"), F.col("x.labels").cast("long").alias(c), F.col("x.ds").alias("d"))

    return labels(first, "first").drop("d").join(
        labels(second, "second").withColumn("d", F.bround("d", 6)), ["group_key", "norm"])


def _nation_entities(spark, sf):
    return TB.load(spark, sf, "nation").select(F.col("n_name").alias("name"),
                                               F.col("n_nationkey").alias("ent_ord"))


ENTITY_SQL = f"""
WITH q AS (SELECT DISTINCT nation_text AS query FROM ({TB.MESSY_SUPPLIER_NATION_SQL}) m
           WHERE nation_text IS NOT NULL),
e AS (SELECT n_name AS name, n_nationkey AS ent_ord FROM nation WHERE n_name IS NOT NULL AND n_name <> ''),
{O.search_ctes('q', 'query')}
SELECT query, name AS canonical, score FROM best"""


@query("entity_match", ENTITY_SQL)
def q_entity_match(spark, sf):
    """Canonical nation name per supplier nation text."""
    from canonspark.operators import entity as EN
    q = TB.messy_supplier_nation(spark, sf).select(F.col("nation_text").alias("query"))
    return EN.canonical_names(q, _nation_entities(spark, sf))


KG_LONG = O.melt_sql(TB.MESSY_SUPPLIER_NATION_SQL, ["nation_text"], None)
KG_SQL = f"""WITH RECURSIVE {O.node_ctes(KG_LONG, 'direct')}, {O.edge_ctes('ratio', 75)},
{O.cluster_ctes('first_fit')},
e AS (SELECT n_name AS name, n_nationkey AS ent_ord FROM nation WHERE n_name IS NOT NULL AND n_name <> ''),
{O.search_ctes('(SELECT DISTINCT norm AS query FROM clustered)', 'query')}
SELECT c.group_key, CAST(c.cluster_id AS BIGINT) AS cluster_id, arg_min(b.name, c.okey) AS suggestion,
       'google_kg' AS suggestion_mode
FROM clustered c JOIN best b ON b.query = c.norm GROUP BY c.group_key, c.cluster_id"""


@query("kg_suggestions", KG_SQL)
def q_kg_suggestions(spark, sf):
    """Knowledge-source suggestion per cluster of supplier nation texts (J10 + G5 input)."""
    from canonspark.operators import entity as EN
    raw = TB.messy_supplier_nation(spark, sf)
    g = CL.group_in_column(raw, ["nation_text"])
    out = EN.kg_suggestion_overrides(g.clustered, _nation_entities(spark, sf))
    return out.select("group_key", F.col("cluster_id").cast("long").alias("cluster_id"),
                      "suggestion", "suggestion_mode")


# ------------------------------------------------------------------ ingest

_NA = "(" + ", ".join("'" + t + "'" for t in CSV.NA_TOKENS) + ")"


def _missing_sql(x: str) -> str:
    return f"CASE WHEN {x} IN {_NA} THEN NULL ELSE {x} END"


def _scratch(spark, name: str) -> str:
    import uuid

    from canonspark.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/canonspark-{name}-{uuid.uuid4()}"


_BROKEN_SQL = """SELECT row_id, category, name_b,
       CASE WHEN row_id % 5 = 0 THEN name_a || chr(10) || 'said "yes", ' || chr(10) || chr(10) ELSE name_a END AS name_a
FROM ({0}) b"""


@query("csv_round_trip", f"""
SELECT CAST(row_id AS VARCHAR) AS row_id, {_missing_sql('category')} AS "a.category",
       {_missing_sql('name_a')} AS name_a, {_missing_sql('name_b')} AS name_b
FROM ({_BROKEN_SQL.format(TB.MESSY_PART_SQL)}) m""")
def q_csv_round_trip(spark, sf):
    """Messy part, some fields with line breaks and quotes, written as CSV (S6) and read
    back with the missing-value tokens."""
    path = _scratch(spark, "csv")
    broken = F.when(F.col("row_id") % 5 == 0, F.concat("name_a", F.lit('\nsaid "yes", \n\n'))).otherwise(F.col("name_a"))
    raw = TB.messy_part(spark, sf).withColumn("name_a", broken).withColumnRenamed("category", "a.category")
    TB.write_table(raw, path, "csv")
    return CSV.read_csv(spark, path)


@query("records_ingest", f"""
SELECT shape, row_id, category, name_a FROM ({TB.MESSY_PART_SQL}) m, (SELECT unnest(['rows', 'lists']) AS shape) s""")
def q_records_ingest(spark, sf):
    """Both JSON shapes (S3): one record a line, and column lists of 100 rows a line."""
    from pyspark.sql import types as ST
    raw = TB.messy_part(spark, sf).select("row_id", "category", "name_a")
    rows, lists = _scratch(spark, "rows"), _scratch(spark, "lists")
    TB.write_table(raw, rows, "json")
    def column(c: str):
        return F.transform("r", lambda x: F.coalesce(x[c].cast("string"), F.lit("<none>"))).alias(c)

    each = F.struct(*[column(c) for c in raw.columns])
    packed = raw.groupBy(F.floor(F.col("row_id") / 100)).agg(F.collect_list(F.struct(*raw.columns)).alias("r"))
    packed.select(each.alias("o")).select("o.*").write.json(lists)
    text = ST.StructType([ST.StructField(c, ST.StringType()) for c in raw.columns])
    schema = ST.StructType([ST.StructField("row_id", ST.LongType()), *text.fields[1:]])
    a = CSV.read_records(spark, rows, schema)
    b = CSV.read_column_lists(spark, lists, text)
    b = b.select(F.col("row_id").cast("long").alias("row_id"), *[F.nullif(F.col(c), F.lit("<none>")).alias(c)
                                                                   for c in raw.columns[1:]])
    return (a.withColumn("shape", F.lit("rows")).unionByName(b.withColumn("shape", F.lit("lists")))
            .select("shape", "row_id", "category", "name_a"))


HISTORY_COLS = ["file_name", "cleaning_mode", "acceptance_ratio", "user_id", "column", "total_values",
                "num_of_before_unique", "num_of_after_unique", "manual_corrections", "num_of_clusters",
                "num_of_majority", "total_num_of_single", "num_of_spell_check", "num_of_global_manual",
                "num_of_gkg", "num_of_llm", "summary_acceptance_ratio"]


def _history_sql() -> str:
    parts = []
    for mode in ("direct", "category"):
        tail = f"""
SELECT 'messy_part.csv' AS file_name, '{mode}' AS cleaning_mode,
       (SELECT CAST(coalesce(round_even(avg(acceptance_ratio), 3), 0.0) AS DOUBLE) FROM summ) AS acceptance_ratio,
       CAST(1 AS BIGINT) AS user_id, "column", total_values, num_of_before_unique, num_of_after_unique,
       manual_corrections, num_of_clusters, num_of_majority, total_num_of_single, num_of_spell_check,
       num_of_global_manual, num_of_gkg, num_of_llm, acceptance_ratio AS summary_acceptance_ratio
FROM summ"""
        parts.append(f"SELECT * FROM ({_apply_sql(mode, tail)}) h_{mode}")
    return " UNION ALL ".join(parts)


@query("history_runs", _history_sql())
def q_history_runs(spark, sf):
    import uuid

    from canonspark.session import ensure_checkpoint_dir
    from canonspark.sources import history as H
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/canonspark-history-{uuid.uuid4()}"
    for mode in ("direct", "category"):
        a = _applied(spark, sf, mode)
        H.save_run(base, 1, "messy_part.csv", mode, a.overall, a.summary)
    return H.history(spark, base, 1).select(*HISTORY_COLS)


# ------------------------------------------------------------------ wave 6 (streaming)

@query("stream_apply_map", f"""
SELECT event_id, event_type, {O.norm('event_type')} AS event_type_cleaned FROM events""")
def q_stream_apply_map(spark, sf):
    """Learn the value map of ``events.event_type`` in batch, then clean the
    events table read as a stream; returns what the stream wrote."""
    import uuid

    from canonspark.session import ensure_checkpoint_dir
    from canonspark.streaming import apply_stream as ST
    events = TB.load(spark, sf, "events")
    vmap = CL.group_in_column(events.withColumn("row_id", F.col("event_id")), ["event_type"]).value_map()
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/canonspark-stream-{uuid.uuid4()}"
    stream = (spark.readStream.schema(events.schema)
              .option("pathGlobFilter", "events.parquet").parquet(sf))
    ST.run_to_parquet(stream.select("event_id", "event_type"), vmap, "event_type",
                      f"{base}/out", f"{base}/_checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("stream_learn_clusters", _clusters_sql(O.melt_sql(TB.MESSY_PART_SQL, ["name_a"], None), "direct", "leader"))
def q_stream_learn_clusters(spark, sf):
    """The messy names as a stream of two files; unseen values join or open clusters as they come."""
    from canonspark.streaming import learn_stream as LS
    base = _scratch(spark, "learn")
    raw = TB.messy_part(spark, sf).select("row_id", "name_a")
    half = raw.agg(F.expr("percentile_approx(row_id, 0.5)")).first()[0]
    for part in (raw.where(F.col("row_id") <= half), raw.where(F.col("row_id") > half)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    LS.learn(stream, "name_a", "row_id", f"{base}/state", f"{base}/_checkpoint")
    return LS.clusters(spark, f"{base}/state").select("group_key", "norm", F.col("cluster_id").cast("long").alias("cluster_id"))


def _exact_sql(long_sql: str) -> str:
    return f"""WITH RECURSIVE {O.node_ctes(long_sql, 'direct')}, {O.edge_ctes('ratio', 75)},
occs AS MATERIALIZED (SELECT group_key, norm, okey,
                             row_number() OVER (PARTITION BY group_key ORDER BY okey) AS oi FROM nlf),
vn AS (SELECT group_key, a AS x, b AS y FROM edges UNION ALL SELECT group_key, b, a FROM edges
       UNION ALL SELECT group_key, norm, norm FROM nodes),
preds AS (SELECT o.group_key, o.oi, max(p.oi) AS pj
          FROM occs o JOIN vn ON vn.group_key = o.group_key AND vn.x = o.norm
          JOIN occs p ON p.group_key = o.group_key AND p.norm = vn.y AND p.oi < o.oi
          GROUP BY o.group_key, o.oi, vn.y),
lowers AS (SELECT group_key, oi, list(pj) AS lower FROM preds GROUP BY ALL),
nn AS MATERIALIZED (SELECT o.group_key, o.oi AS idx, coalesce(l.lower, []::BIGINT[]) AS lower
                    FROM occs o LEFT JOIN lowers l USING (group_key, oi)),
seq(group_key, i, labels) AS (
    SELECT DISTINCT group_key, CAST(0 AS BIGINT), []::BIGINT[] FROM occs
    UNION ALL
    SELECT s.group_key, s.i + 1,
           list_append(s.labels, coalesce(list_min(list_transform(nn.lower, lambda j: s.labels[j])), s.i + 1))
    FROM seq s JOIN nn ON nn.group_key = s.group_key AND nn.idx = s.i + 1),
fin AS (SELECT group_key, labels FROM
          (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY i DESC) AS rn FROM seq) WHERE rn = 1),
lab AS (SELECT group_key, unnest(labels) AS leader, generate_subscripts(labels, 1) AS oi FROM fin)
SELECT o.group_key, CAST(o.okey % 1000000000000 AS BIGINT) AS row_id, o.norm,
       CAST(dense_rank() OVER (PARTITION BY o.group_key ORDER BY l.leader) AS BIGINT) AS cluster_id
FROM occs o JOIN lab l USING (group_key, oi)"""


@query("first_fit_exact", _exact_sql(MESSY_LONG_DIRECT))
def q_first_fit_exact(spark, sf):
    g = CL.group_in_column(TB.messy_part(spark, sf), MESSY_COLS, exact=True)
    return g.occurrence_clusters.select("group_key", F.col("occ.row_id").alias("row_id"), "norm",
                                        F.col("cluster_id").cast("long").alias("cluster_id"))
