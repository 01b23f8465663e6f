"""Canonical names from an entity table.

The entity table stands for a name search.  A text's *keys* are the pairs of
neighbouring characters of the lower-cased text (the text itself if it is shorter).
A key that few entities have weighs more: ``floor(1000 (1 + ln(N / df)))``, for N
entities of which df have it.  An entity's relevance for a query is the weight of
the keys that both have; the search returns at most ``max_candidates`` entities by
relevance, then by entity order (L5).  The candidate with the best ``partial_ratio``
is the canonical name, however low its score; ties go to the earlier candidate.  A
text without a shared key has no candidate and is left out.  Per cluster, the first
member (in member order) that has a canonical name supplies the suggestion (mode
``google_kg``).

The search is a MaxScore search over postings.  The postings of a query's weightiest
key are scored first; the relevance of the last of the best ones is a bound.  An
entity that shares only keys whose weights together stay below the bound can't be
among the best, so the postings of the query's lightest keys, up to that sum, are
never read: a pair like ``in`` joins no query to nearly all entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.functions import similarity as S
from canonspark.operators import suggest as SG
from canonspark.operators.topk import top_k_per_group
from canonspark.session import ensure_checkpoint_dir

# Fixed value: the reference takes 5 results of a search
MAX_CANDIDATES = 5


def _keys(text: Column) -> Column:
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, 2))
    return F.array_distinct(F.when(n >= 2, pairs).otherwise(F.array(text)))


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _relevance(known: Column, keys: Column) -> Column:
    """Weight of the query's weighted keys that an entity has."""
    return F.aggregate(F.filter(known, lambda x: F.array_contains(keys, x["k"])), F.lit(0).cast("long"),
                       lambda total, x: total + x["w"])


def search(queries: DataFrame, entities: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """``queries(query, ql)`` x ``entities(name, ent_ord, el)`` -> the best ``most`` entities of every
    query: ``query, ql, name, ent_ord, el, relevance, place``."""
    e = entities.withColumn("keys", _keys(F.col("el")))
    postings = _checkpoint(e.withColumn("k", F.explode("keys")))
    total = entities.count()
    weight = F.floor(F.lit(1000.0) * (F.lit(1.0) + F.log(F.lit(float(total)) / F.col("df")))).cast("long")
    df = postings.groupBy("k").agg(F.count(F.lit(1)).alias("df")).select("k", weight.alias("w"))
    # a query's keys, the weightiest first
    q = _checkpoint(queries.withColumn("k", F.explode(_keys(F.col("ql")))).join(df, "k").groupBy("query", "ql").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("low"), "k"))),
                    lambda x: F.struct((-x["low"]).alias("w"), x["k"].alias("k"))).alias("known")))
    order = [F.desc("relevance"), F.col("ent_ord"), F.col("name")]

    def found(some: DataFrame) -> DataFrame:
        """Entities of the postings of ``some(query, ql, known, k)``, each once, with their whole relevance:
        at the first of the query's keys that both have and that is looked up."""
        return (some.join(postings, "k")
                .where(F.col("k") == F.element_at(F.filter("known", lambda x: F.array_contains("keys", x["k"])), 1)["k"])
                .withColumn("relevance", _relevance(F.col("known"), F.col("keys"))))

    first = found(q.withColumn("k", F.col("known")[0]["k"]))
    bound = (top_k_per_group(first.select("query", "relevance", "ent_ord", "name"), ["query"], order, most, out="place")
             .where(F.col("place") == most).select("query", F.col("relevance").alias("bound")))
    rest = q.join(bound, "query", "left").fillna(0, ["bound"])
    # keys whose weight and that of all lighter ones reach the bound are looked up
    tail = F.transform(F.col("known"), lambda _, i: F.aggregate(
        F.slice("known", i + 1, F.size("known")), F.lit(0).cast("long"), lambda a, x: a + x["w"]))
    looked = F.filter(F.arrays_zip(F.col("known.k").alias("k"), tail.alias("t")), lambda x: x["t"] >= F.col("bound"))
    wanted = rest.withColumn("k", F.explode(F.transform(looked, lambda x: x["k"]))).drop("bound")
    cand = found(wanted).select("query", "ql", "name", "ent_ord", "el", "relevance")
    return top_k_per_group(cand, ["query"], order, most, out="place")


def canonical_names(queries: DataFrame, entities: DataFrame, max_candidates: int = MAX_CANDIDATES,
                    query_col: str = "query", name_col: str = "name", order_col: str = "ent_ord") -> DataFrame:
    """``queries(<query_col>)`` x ``entities(<name_col>, <order_col>)`` ->
    ``query, canonical, score``.  Null and empty texts have no key."""
    q = (queries.select(F.col(query_col).alias("query")).where("query is not null and query != ''").distinct()
         .withColumn("ql", F.lower("query")))
    e = (entities.select(F.col(name_col).alias("name"), F.col(order_col).alias("ent_ord"))
         .where("name is not null and name != ''").withColumn("el", F.lower("name")))
    scored = search(q, e, max_candidates).withColumn("score", S.score_column("partial_ratio", "ql", "el"))
    return scored.groupBy("query").agg(
        F.min_by(F.struct("name", "score"), F.struct((-F.col("score")).alias("low"), "place")).alias("best")
    ).select("query", F.col("best.name").alias("canonical"), F.col("best.score").alias("score"))


def kg_suggestion_overrides(clustered: DataFrame, entities: DataFrame, **kw) -> DataFrame:
    """Per cluster, the canonical name of its first member that has one:
    ``group_key, cluster_id, suggestion, suggestion_mode='google_kg'``."""
    names = canonical_names(clustered.select(F.col("norm").alias("query")), entities, **kw)
    hit = clustered.join(names, clustered["norm"] == names["query"])
    return (hit.groupBy("group_key", "cluster_id")
            .agg(F.min_by("canonical", "occ").alias("suggestion"))
            .withColumn("suggestion_mode", F.lit(SG.KG)))
