"""SP1-SP3, J8, J9: dictionary membership and spelling correction.

A word that is in the dictionary is itself; else the dictionary words at
(unrestricted) Damerau-Levenshtein distance 1, else 2; the most frequent
candidate wins, ties alphabetical.  Numbers, ``nan`` and words longer than the
longest dictionary word plus 3 are left alone; a word without candidates is
kept.

Candidates come from two equi-joins.  Dictionary words of at most 20 letters: every
edit costs at most one deletion on each side, so two words within distance 2
share a string obtained by at most two deletions from each (at most 254 strings a
word).  Longer ones are cut into five segments: an edit touches two neighbouring
segments at most (a transposition across a cut), so two edits leave one whole,
shifted by two places at most (5 keys, at most 125 probes).  Keys meet by their
hash; the distance of every candidate is checked.

A bounded Levenshtein distance in the JVM decides most candidates.  A transposition
is two Levenshtein edits and leaves the letters as they are, so at distance 2 only
words of the same letters can be one edit apart, at distance 3 the letters differ by
one edit at most, and at distance 4 they are the same.  Only such pairs have their
exact distance computed.

A word longer than the longest dictionary word plus 3 is not looked up, as the
reference has it; no dictionary word is within two edits of it anyway.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonspark.functions import text as TX
from canonspark.session import ensure_checkpoint_dir

# Words the spell checker leaves unchanged
SKIP_WORDS = ("nan",)
FLOAT_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
LONG_WORD_SLACK = 3
SHORT, SEGMENTS = 20, 5


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (edits may compose)."""
    la, lb = len(a), len(b)
    inf = la + lb
    h = [[0] * (lb + 2) for _ in range(la + 2)]
    h[0][0] = inf
    for i in range(la + 1):
        h[i + 1][0] = inf
        h[i + 1][1] = i
    for j in range(lb + 1):
        h[0][j + 1] = inf
        h[1][j + 1] = j
    last: dict[str, int] = {}
    for i in range(1, la + 1):
        db = 0
        for j in range(1, lb + 1):
            i1 = last.get(b[j - 1], 0)
            j1 = db
            if a[i - 1] == b[j - 1]:
                cost = 0
                db = j
            else:
                cost = 1
            h[i + 1][j + 1] = min(h[i][j] + cost, h[i + 1][j] + 1, h[i][j + 1] + 1,
                                  h[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return h[la + 1][lb + 1]


@F.pandas_udf(T.IntegerType())
def dl_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau_levenshtein(x, y) for x, y in zip(a, b)], dtype="int32")


def _deletes_sql(col: str) -> Column:
    """A short word without 0, 1 or 2 of its letters."""
    return F.expr(f"""
      array_distinct(flatten(array(
        array({col}),
        transform(sequence(1, greatest(length({col}), 1)),
                  i -> concat(substr({col}, 1, i - 1), substr({col}, i + 1))),
        flatten(transform(sequence(1, greatest(length({col}), 1)),
                  i -> transform(sequence(i + 1, greatest(length({col}), i + 1)),
                       j -> concat(substr({col}, 1, i - 1), substr({col}, i + 1, j - i - 1),
                                   substr({col}, j + 1)))))
      )))""")


def _segment(n: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a word of length n."""
    lo, hi = (F.floor(n * x / SEGMENTS).cast("int") for x in (i, i + 1))
    return lo + 1, hi - lo


def _segment_key(word: Column, n: Column, i: Column, by: Column) -> Column:
    """Segment i of a word of length n, as it stands in ``word`` moved by some places."""
    at, size = _segment(n, i)
    return F.when((at + by >= 1) & (at + by + size - 1 <= F.length(word)), F.struct(
        i.alias("i"), n.alias("n"), F.substr(word, at + by, size).alias("s")))


def _each(first: int, last: int, body) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(last)), body)


def _segment_keys(word: Column) -> Column:
    return _each(0, SEGMENTS - 1, lambda i: _segment_key(word, F.length(word), i, F.lit(0)))


def _probe_keys(word: Column, distance: int) -> Column:
    """The segment keys of every word within the distance: its length and the place
    of the segment that is left whole differ by that much at most.  Loops in the
    expression, as plans hold every expression written out."""
    out = _each(-distance, distance, lambda by: F.flatten(_each(0, SEGMENTS - 1, lambda i: _each(
        -distance, distance, lambda shift: _segment_key(word, F.length(word) + by, i, shift)))))
    return F.filter(F.array_distinct(F.flatten(out)), lambda x: x.isNotNull())


def _hashes(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.xxhash64(k))


def _letters(word: str) -> Column:
    """The letters of a word in alphabetical order."""
    return F.array_join(F.sort_array(F.split(F.col(word), "")), "")


def _may_be_within(distance: int) -> Column:
    """With n transpositions among the edits: Levenshtein at most ``distance + n``, and
    the letters at most ``distance - n`` edits apart (``apart``: of the sorted letters,
    of which a replaced one moves, which is two)."""
    fits = F.col("lev") <= distance
    for n in range(1, distance + 1):
        fits = fits | ((F.col("lev") <= distance + n) & (F.col("apart") <= 2 * (distance - n)))
    return fits


def should_check(word: Column, longest: Column) -> Column:
    return (~F.lower(word).rlike(FLOAT_PATTERN)) & (~F.lower(word).isin(*SKIP_WORDS)) \
        & (F.length(word) <= longest + F.lit(LONG_WORD_SLACK))


def correct_words(words: DataFrame, dictionary: DataFrame, max_distance: int = 2) -> DataFrame:
    """``words(word)`` (distinct) -> ``word, correction, tier`` (tier NULL: kept as is)."""
    ensure_checkpoint_dir(words.sparkSession)
    d = dictionary.select(F.col("word").alias("dword"), F.col("freq").cast("long").alias("freq"))
    longest = d.agg(F.max(F.length("dword"))).first()[0] or 0  # one scalar
    w = words.select("word").distinct()
    # checkpoints where a table is read more than once: the driver plans it once then
    w = (w.join(d.select("dword").distinct(), w.word == F.col("dword"), "left")
         .select("word", F.col("dword").isNotNull().alias("known")).checkpoint(eager=True))
    unknown = w.where(~F.col("known") & should_check(F.col("word"), F.lit(longest))).select("word")
    # words of other lengths than the unknown ones have no place in the join
    span = unknown.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    d = d.where(F.length("dword").between((span[0] or 0) - max_distance, (span[1] or 0) + max_distance))
    short, long = d.where(F.length("dword") <= SHORT), d.where(F.length("dword") > SHORT)
    by_deletes = (
        unknown.where(F.length("word") <= SHORT + max_distance)
        .select("word", F.explode(_hashes(_deletes_sql("word"))).alias("key"))
        .join(short.select("dword", "freq", F.explode(_hashes(_deletes_sql("dword"))).alias("key")), "key").drop("key"))
    by_segments = (
        unknown.where(F.length("word") > SHORT - max_distance)
        .select("word", F.explode(_probe_keys(F.col("word"), max_distance)).alias("key"))
        .join(long.select("dword", "freq", F.explode(_segment_keys(F.col("dword"))).alias("key")), "key")
        .drop("key"))
    # a transposition is two Levenshtein edits, so two edits are four at most
    near = F.abs(F.length("word") - F.length("dword")) <= max_distance
    cand = (by_deletes.unionByName(by_segments).where(near)
            .withColumn("lev", F.expr(f"levenshtein(word, dword, {2 * max_distance})")).where("lev >= 0")
            .withColumn("apart", F.when(F.col("lev") <= 1, F.lit(0)).otherwise(
                F.levenshtein(_letters("word"), _letters("dword"))))
            .where(_may_be_within(max_distance)).distinct().checkpoint(eager=True))
    sure = (F.col("lev") <= 1) | ((F.col("lev") == 2) & (F.col("apart") > 0))
    cand = (cand.where(sure).withColumn("tier", F.col("lev"))
            .unionByName(cand.where(~sure).withColumn("tier", dl_udf("word", "dword")))
            .where((F.col("tier") >= 1) & (F.col("tier") <= max_distance)))
    best = (cand.groupBy("word")
            .agg(F.min_by(F.struct("dword", "tier"),
                          F.struct("tier", (-F.col("freq")).alias("nf"), "dword")).alias("b"))
            .select("word", F.col("b.dword").alias("correction"), F.col("b.tier").alias("tier")))
    return (w.join(best, "word", "left")
            .select("word", F.coalesce("correction", "word").alias("correction"),
                    F.when(F.col("known"), F.lit(0)).otherwise(F.col("tier")).alias("tier")))


def correct_phrases(phrases: DataFrame, dictionary: DataFrame, col: str = "norm") -> DataFrame:
    """SP1: ``phrases(<col>)`` distinct -> ``<col>, corrected``: every whitespace
    word corrected, words joined by one space; '' falls back to the phrase."""
    p = phrases.select(col).distinct()
    exploded = p.select(col, F.posexplode(TX.words(F.col(col))).alias("pos", "word"))
    fixes = correct_words(exploded.select("word"), dictionary)
    rebuilt = (exploded.join(fixes, "word")
               .groupBy(col)
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "correction"))),
                                             lambda s: s["correction"]), " ").alias("corrected")))
    return (p.join(rebuilt, col, "left")
            .select(col, F.when(F.coalesce(F.col("corrected"), F.lit("")) == "", F.col(col))
                    .otherwise(F.col("corrected")).alias("corrected")))


def in_dictionary(values: DataFrame, dictionary: DataFrame, col: str = "norm") -> DataFrame:
    """Flag whole values that are dictionary words."""
    d = dictionary.select(F.col("word").alias("_dw")).distinct()
    return (values.join(d, values[col] == d["_dw"], "left")
            .withColumn("in_dict", F.col("_dw").isNotNull()).drop("_dw"))
