"""Similar pairs of distinct values inside each group (fuzzy self-join).

Input ``nodes(group_key, norm, occ)``: one row per distinct normalised value
per group, ``occ`` = first occurrence (a struct, compared field by field).
Output ``edges(group_key, u, v, a, b, score)``: ``u < v`` are the first
occurrences of ``a`` and ``b``; one row per unordered pair with
``score(a, b) >= threshold``.

Candidates come from exact prefix filters, never from a group's cross product.
A text's *marks* are its characters with a running number (the second ``e`` is
``e2``), ordered by their frequency in the group, rarest first.

* Indel family: ``200 * LCS / (la + lb) >= t`` needs ``o = ceil(t (la + lb) / 200)``
  common marks.  Among the first ``la - o + m`` marks of a and ``lb - o + m`` of
  b at least m are common (with m <= o), so the join key is
  ``(group, la, lb, m-subset of the first marks)``.  m falls with the length, so
  that a text has few subsets.  A pair is kept at its first common subset only,
  and only with o common marks in all; then a bounded ``levenshtein`` prunes.
  Among many texts, lengths that leave few letters over (``la - o`` and ``lb - o``) are
  joined on what is left when as many letters are taken out: a pair meets if and only
  if it has a common subsequence of o characters, so the join has results alone.
* Partial family: a window that scores t shares ``o = ceil(t ls / (200 - t))`` marks
  with the shorter text; the first ``ls - o + m`` marks of the shorter one meet all
  marks of the longer one.
* Token-set family: both scores of texts without a common word, and the ratio of
  the two whole word lists, are Indel scores of the *distinct* words (above).  The
  ratio of the common words to one whole list needs the common words to cover
  ``t / (200 - t)`` of that list: its rarest words up to the uncovered rest meet all
  words of the other text.
* Where one common word alone is a full score (partial token scorers), pairs of
  texts with a common word are results, and the join on words has no others.

A threshold of 0 or less links everything; then the pairs of a group are the
result.  Hot keys are found by a frequency sketch before the join and dealt into cells;
what else is skewed is split by adaptive execution (both sides of every join are
plain shuffles).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonspark.functions import similarity as S
from canonspark.functions import text as T
from canonspark.session import ensure_checkpoint_dir

INDEL_FAMILY = {"ratio", "QRatio", "token_sort_ratio"}
# subset size by the length of the longer text: rare marks say less in long texts
SUBSET_STEPS = ((12, 3), (24, 2))
DELETIONS, KEYS = 3, 500  # letters left out of a text, and strings of a text that are used as keys
HOT_KEYS, CELL_ROWS = 1000, 4000  # hot keys that are told apart; rows of one side of a cell
SLACK = 1e-9  # thresholds may be fractions; a need is never rounded up past its value


def _chars(c: Column) -> Column:
    return F.when(F.length(c) >= 1, F.split(c, "(?!$)")).otherwise(F.array().cast("array<string>"))


def _marks(c: Column) -> Column:
    """Characters with a running number, in text order."""
    chars = _chars(c)
    return F.transform(chars, lambda x, i: F.concat(
        x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _with_marks(nodes: DataFrame, key: Column) -> DataFrame:
    """Texts with their marks as numbers: a mark's place in its group, rarest first."""
    base = nodes.select("group_key", "norm", "occ", key.alias("k")).withColumn("len", F.length("k"))
    marked = base.where("len > 0").select("group_key", "norm", "occ", "k", "len", F.explode(_marks(F.col("k"))).alias("m"))
    # a group has as many marks as its characters and their repetitions in one text
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("f", "m"))
    freq = (marked.groupBy("group_key", "m").agg(F.count(F.lit(1)).alias("f")).withColumn("r", place)
            .select("group_key", "m", "r"))
    ordered = (marked.join(freq, ["group_key", "m"])
               .groupBy("group_key", "norm", "occ", "k", "len").agg(F.array_sort(F.collect_list("r")).alias("marks")))
    empty = base.where("len = 0").withColumn("marks", F.expr("cast(array() as array<int>)"))
    ensure_checkpoint_dir(nodes.sparkSession)
    return ordered.unionByName(empty).checkpoint(eager=True)


def _subsets(marks: Column, size: Column) -> Column:
    """All subsets of 0, 1, 2 or 3 marks in order."""
    n = F.size(marks)

    def upto(first: Column, body) -> Column:
        return F.flatten(F.transform(F.when(first <= n, F.sequence(first, n)).otherwise(
            F.expr("cast(array() as array<int>)")), body))

    one = F.transform(marks, lambda x: F.array(x))
    two = upto(F.lit(1), lambda i: F.transform(
        F.slice(marks, i + 1, n), lambda y: F.array(F.element_at(marks, i), y)))
    three = upto(F.lit(1), lambda i: F.flatten(F.transform(
        F.when(i + 1 <= n, F.sequence(i + 1, n)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda j: F.transform(F.slice(marks, j + 1, n), lambda z: F.array(
            F.element_at(marks, i), F.element_at(marks, j), z)))))
    return (F.when(size == 0, F.array(F.expr("cast(array() as array<int>)")))
            .when(size == 1, one).when(size == 2, two).otherwise(three))


def _first_subset(a: Column, b: Column, size: Column) -> Column:
    """The first common subset of two mark lists in the same order."""
    return F.slice(F.array_intersect(a, b), F.lit(1), size)


def _cells(a: DataFrame, b: DataFrame, keys: list[str], texts: int) -> DataFrame:
    """``a`` joined to ``b`` on ``keys``.  A mergeable sketch of frequent items names the hot keys
    (at most ``HOT_KEYS``); both sides of such a key are dealt into parts, and every pair
    of parts is a cell of its own, in which each pair of rows meets once.  A text has a
    key once, so no key has more rows than there are ``texts``."""
    if texts <= CELL_ROWS:
        return a.join(b, keys)
    h = F.xxhash64(*keys)
    both = a.select(h.alias("h")).unionByName(b.select(h.alias("h")))
    top = both.agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {16 * HOT_KEYS})").alias("t")).first()["t"] or []
    hot = {r["item"]: -(-r["count"] // (2 * CELL_ROWS)) for r in top if r["count"] > 2 * CELL_ROWS}
    if not hot:
        return a.join(b, keys)
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), h), F.lit(1).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        return (side.withColumn("_parts", parts)
                .withColumn(own, F.pmod(F.xxhash64(*side.columns), F.col("_parts")))
                .withColumn(other, every).drop("_parts"))

    return dealt(a, "_i", "_j").join(dealt(b, "_j", "_i"), [*keys, "_i", "_j"]).drop("_i", "_j")


def _need(t: float, total: Column) -> Column:
    """Common marks that an Indel score of t needs over ``total`` characters."""
    return F.ceil(total * F.lit(t / 200.0) - F.lit(SLACK)).cast("int")


def _subset_size(longer: Column, need: Column) -> Column:
    size = F.lit(1)
    for length, m in reversed(SUBSET_STEPS):
        size = F.when(longer <= length, F.lit(m)).otherwise(size)
    return F.least(size, F.greatest(need, F.lit(0)))


def _strings_left(n: Column, out: Column) -> Column:
    """Ways to take ``out`` of n letters (up to ``DELETIONS``, else null)."""
    n = n.cast("double")
    return F.when(out == 0, F.lit(1.0)).when(out == 1, n).when(out == 2, n * (n - 1) / 2).when(
        out == 3, n * (n - 1) * (n - 2) / 6)


def _without(text: Column, out: int) -> Column:
    """The strings that are left of a text without ``out`` of its letters."""
    n = F.length(text)

    def drop(kept: Column, at: Column, left: int) -> Column:
        if not left:
            return F.array(F.concat(kept, F.substr(text, at)))
        places = F.when(at <= n, F.sequence(at, n)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.flatten(F.transform(places, lambda i: drop(F.concat(kept, F.substr(text, at, i - at)), i + 1, left - 1)))

    return F.array_distinct(drop(F.lit(""), F.lit(1), out))


def _pairs_deleted(placed: DataFrame, texts: int) -> DataFrame:
    """Pairs with a common subsequence of ``need`` characters: equal without the others."""
    keys = F.lit(None).cast("array<string>")
    for out in range(DELETIONS, -1, -1):
        keys = F.when(F.col("len") - F.col("need") == out, _without(F.col("k"), out)).otherwise(keys)
    keyed = placed.withColumn("key", F.explode(keys))
    a = keyed.where("len <= other").select("group_key", "key", F.col("len").alias("la"), F.col("other").alias("lb"),
                                           F.col("norm").alias("a"), F.col("occ").alias("ua"))
    b = keyed.where("len >= other").select("group_key", "key", F.col("other").alias("la"), F.col("len").alias("lb"),
                                           F.col("norm").alias("b"), F.col("occ").alias("ub"))
    j = _cells(a, b, ["group_key", "key", "la", "lb"], texts).where("la < lb or a < b")
    return _oriented(j).dropDuplicates(["group_key", "a", "b"])


def _oriented(pairs: DataFrame) -> DataFrame:
    """One orientation (a < b) for the pairs of every generator."""
    swap = F.col("a") > F.col("b")
    return pairs.select("group_key",
                        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
                        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
                        F.when(swap, F.col("ub")).otherwise(F.col("ua")).alias("ua"),
                        F.when(swap, F.col("ua")).otherwise(F.col("ub")).alias("ub"))


def _everything(nodes: DataFrame) -> DataFrame:
    """All pairs of a group: the result itself where every score is high enough."""
    a = nodes.select("group_key", F.col("norm").alias("a"), F.col("occ").alias("ua"))
    b = nodes.select("group_key", F.col("norm").alias("b"), F.col("occ").alias("ub"))
    return a.join(b, "group_key").where("a < b").select("group_key", "a", "b", "ua", "ub")


def _pairs_indel(nodes: DataFrame, key: Column, t: float, texts: int, in_order: bool = True) -> DataFrame:
    """Pairs that an Indel score >= t of ``key`` allows, each once; not ``in_order``:
    of the words of ``key`` in any order."""
    if t > 100 + SLACK:
        return _oriented(_everything(nodes).limit(0))
    k = _with_marks(nodes, key)
    # lengths that occur in the group: at most as many as the longest text has characters
    lengths = k.groupBy("group_key").agg(F.sort_array(F.collect_set("len")).alias("lens"))
    total = F.col("len") + F.col("other")
    need = _need(t, total)
    placed = (k.join(lengths, "group_key").withColumn("other", F.explode("lens")).drop("lens")
              .withColumn("need", need).where(F.col("need") <= F.least("len", "other")))
    deleted = None
    if texts > CELL_ROWS:
        # a row becomes many keys: deal the rows out by number, not by their bytes
        placed = placed.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                                    "group_key", "norm", "other")
    if in_order and texts > CELL_ROWS:
        few = F.coalesce(F.greatest(*[_strings_left(n, n - F.col("need")) for n in (F.col("len"), F.col("other"))])
                         <= KEYS, F.lit(False)) & (F.greatest("len", "other") - F.col("need") <= DELETIONS)
        deleted = _pairs_deleted(placed.where(few), texts)
        placed = placed.where(~few)
    placed = (placed.withColumn("m", _subset_size(F.greatest("len", "other"), F.col("need")))
              .withColumn("head", F.slice("marks", F.lit(1), F.col("len") - F.col("need") + F.col("m")))
              .withColumn("key", F.explode(_subsets(F.col("head"), F.col("m")))))
    a = placed.where("len <= other").select(
        "group_key", "key", F.col("len").alias("la"), F.col("other").alias("lb"), "m", "need",
        F.col("norm").alias("a"), F.col("occ").alias("ua"), F.col("k").alias("ka"),
        F.col("head").alias("ha"), F.col("marks").alias("ma"))
    b = placed.where("len >= other").select(
        "group_key", "key", F.col("other").alias("la"), F.col("len").alias("lb"),
        F.col("norm").alias("b"), F.col("occ").alias("ub"), F.col("k").alias("kb"),
        F.col("head").alias("hb"), F.col("marks").alias("mb"))
    j = _cells(a, b, ["group_key", "key", "la", "lb"], texts)
    j = (j.where((F.col("la") < F.col("lb")) | (F.col("a") < F.col("b")))
         .where(_first_subset(F.col("ha"), F.col("hb"), F.col("m")) == F.col("key"))
         .where(F.size(F.array_intersect("ma", "mb")) >= F.col("need")))
    if in_order:
        # Levenshtein is at most the Indel distance la + lb - 2 * need
        j = j.where(F.expr("levenshtein(ka, kb, la + lb - 2 * need) >= 0"))
    return _oriented(j) if deleted is None else _oriented(j).unionByName(deleted)


def _pairs_partial(nodes: DataFrame, key: Column, t: float, texts: int) -> DataFrame:
    """Pairs that a partial score >= t of ``key`` allows, each once."""
    if t > 100 + SLACK:
        return _oriented(_everything(nodes).limit(0))
    if t <= 0:
        return _oriented(_everything(nodes))
    k = _with_marks(nodes, key).withColumn(
        "need", F.ceil(F.col("len") * F.lit(t / (200.0 - t)) - F.lit(SLACK)).cast("int"))
    # two marks where the shorter text needs two, else one; the longer side gives both
    short = (k.withColumn("m", F.least(F.lit(2), F.col("need")))
             .withColumn("head", F.slice("marks", F.lit(1), F.col("len") - F.col("need") + F.col("m")))
             .select("group_key", F.explode(_subsets(F.col("head"), F.col("m"))).alias("key"), "m", "need",
                     F.col("len").alias("la"), F.col("norm").alias("a"), F.col("occ").alias("ua"),
                     F.col("head").alias("ha"), F.col("marks").alias("ma")))
    long = (k.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
            .select("group_key", F.explode(_subsets(F.col("marks"), F.col("m"))).alias("key"),
                    F.col("len").alias("lb"), F.col("norm").alias("b"), F.col("occ").alias("ub"),
                    F.col("marks").alias("mb")))
    # an empty text scores against an empty text only
    long = long.where("size(key) > 0 or lb = 0")
    j = (_cells(short, long, ["group_key", "key"], texts)
         .where((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b"))))
         .where(_first_subset(F.col("ha"), F.col("mb"), F.col("m")) == F.col("key"))
         .where(F.size(F.array_intersect("ma", "mb")) >= F.col("need")))
    return _oriented(j)


def _words(nodes: DataFrame) -> DataFrame:
    w = nodes.select("group_key", "norm", "occ", F.array_distinct(T.words(F.col("norm"))).alias("words"))
    return w.where(F.size("words") > 0)


def _pairs_shared_word(nodes: DataFrame, texts: int) -> DataFrame:
    """Pairs with a common word, each at its first common word."""
    w = _words(nodes).withColumn("words", F.sort_array("words"))
    tok = w.withColumn("key", F.explode("words"))
    a = tok.select("group_key", "key", F.col("norm").alias("a"), F.col("occ").alias("ua"), F.col("words").alias("wa"))
    b = tok.select("group_key", "key", F.col("norm").alias("b"), F.col("occ").alias("ub"), F.col("words").alias("wb"))
    return _oriented(_cells(a, b, ["group_key", "key"], texts).where("a < b")
                     .where(F.element_at(F.array_intersect("wa", "wb"), 1) == F.col("key")))


def _pairs_covered(nodes: DataFrame, t: float, texts: int) -> DataFrame:
    """Pairs whose common words cover ``t / (200 - t)`` of one text's word list."""
    if t > 100 + SLACK:
        return _oriented(_everything(nodes).limit(0))
    share = max(0.0, t / (200.0 - t))
    w = _words(nodes)
    tok = w.select("group_key", "norm", "occ", F.explode("words").alias("key")).withColumn(
        "weight", F.length("key") + 1)
    freq = tok.groupBy("group_key", "key").agg(F.count(F.lit(1)).alias("f"))
    one = Window.partitionBy("group_key", "norm")          # the words of one text
    before = one.orderBy("f", "key").rowsBetween(Window.unboundedPreceding, -1)
    # the weight of the uncovered words is at most (1 - share) * (weight of all - 1)
    placed = (tok.join(freq, ["group_key", "key"])
              .withColumn("all", F.sum("weight").over(one))
              .withColumn("ahead", F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("leads", F.col("ahead") <= (1 - share) * (F.col("all") - 1) + SLACK))
    a = placed.where("leads").select("group_key", "key", F.col("norm").alias("a"), F.col("occ").alias("ua"))
    b = placed.select("group_key", "key", F.col("norm").alias("b"), F.col("occ").alias("ub"))
    return _oriented(_cells(a, b, ["group_key", "key"], texts).where("a != b"))


def candidate_pairs(nodes: DataFrame, scorer: str, threshold: float) -> DataFrame:
    """A superset of the pairs that reach the threshold, each at least once."""
    S.check_scorer(scorer)
    t = float(threshold)
    if t <= 0:
        return _oriented(_everything(nodes))
    texts = nodes.count()
    norm, in_order = F.col("norm"), T.sorted_tokens(F.col("norm"))
    distinct = F.array_join(F.sort_array(F.array_distinct(T.words(F.col("norm")))), " ")

    def union(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["group_key", "a", "b"])

    if scorer in ("ratio", "QRatio"):
        return _pairs_indel(nodes, norm, t, texts)
    if scorer == "token_sort_ratio":
        return _pairs_indel(nodes, in_order, t, texts)
    if scorer == "token_set_ratio":
        return union(_pairs_indel(nodes, distinct, t, texts, False), _pairs_covered(nodes, t, texts))
    if scorer == "token_ratio":
        return union(_pairs_indel(nodes, distinct, t, texts, False), _pairs_covered(nodes, t, texts), _pairs_indel(nodes, in_order, t, texts))
    if scorer == "partial_ratio":
        return _pairs_partial(nodes, norm, t, texts)
    if scorer == "partial_token_sort_ratio":
        return _pairs_partial(nodes, in_order, t, texts)
    if scorer == "partial_token_set_ratio":
        return union(_pairs_shared_word(nodes, texts), _pairs_partial(nodes, distinct, t, texts))
    if scorer == "partial_token_ratio":
        return union(_pairs_shared_word(nodes, texts), _pairs_partial(nodes, distinct, t, texts), _pairs_partial(nodes, in_order, t, texts))
    # WRatio: the largest of scaled scores; a scaled score needs a higher one of its own
    token, part = t / S.UNBASE_SCALE, t / S.PARTIAL_SCALE
    both = part / S.UNBASE_SCALE
    parts = [_pairs_indel(nodes, norm, t, texts), _pairs_indel(nodes, distinct, token, texts, False), _pairs_covered(nodes, token, texts),
             _pairs_indel(nodes, in_order, token, texts), _pairs_partial(nodes, norm, part, texts),
             _pairs_partial(nodes, distinct, both, texts), _pairs_partial(nodes, in_order, both, texts)]
    if both <= 100 + SLACK:
        parts.append(_pairs_shared_word(nodes, texts))
    return union(*parts)


def fuzzy_edges(nodes: DataFrame, scorer: str = "ratio", threshold: float = 75) -> DataFrame:
    """Exact edges ``score(a, b) >= threshold`` between distinct values of a group."""
    cand = candidate_pairs(nodes, scorer, threshold)
    if scorer not in INDEL_FAMILY:
        # the window scorers cost much more a pair than its bytes suggest: deal the
        # pairs out by key before they are scored
        cand = cand.repartition("group_key", "a", "b")
    # words as columns of their own: split once, used by several parts of a score
    split = cand.withColumns({"wa": T.words("a"), "wb": T.words("b")})
    score = S.score_column(scorer, "a", "b", F.col("wa"), F.col("wb"))
    scored = split.withColumn("score", score).where(F.col("score") >= F.lit(float(threshold)))
    # orient by first occurrence: u is the earlier value
    first = F.col("ua") < F.col("ub")
    return scored.select(
        "group_key",
        F.when(first, F.col("ua")).otherwise(F.col("ub")).alias("u"),
        F.when(first, F.col("ub")).otherwise(F.col("ua")).alias("v"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"),
        "score",
    )
