"""The fuzzy self-join must return exactly the pairs a brute-force loop finds."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canonspark.functions import similarity as S
from canonspark.operators import pairs as PR
from canonspark.operators import reshape as R
from canonspark.plans import catalogue as C

VALUES = ["small ring", "smal ring", "small rings", "ring", "red gear", "gear red", "red gears",
          "blue", "blu", "a b", "b a c", "", "x", "brand4", "brand14", "brand 4", "large widget",
          "widget", "wid get", "small anvil", "anvil small", "hot rod", "hot", "rod hot pink"]


def _nodes(spark, values, group="g"):
    rows = [(group, v, (0, i), 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "group_key string, norm string, "
                                       "occ struct<col_ord:int,row_id:bigint>, n bigint")


@pytest.mark.parametrize("scorer", sorted(S.SCORERS))
@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_edges_equal_brute_force(spark, scorer, threshold):
    got = {(r.a, r.b) for r in PR.fuzzy_edges(_nodes(spark, VALUES), scorer, threshold).collect()}
    fn = S.SCORERS[scorer]
    want = set()
    for i, j in itertools.combinations(range(len(VALUES)), 2):
        if fn(VALUES[i], VALUES[j]) >= threshold:
            want.add((VALUES[i], VALUES[j]))
    assert got == want


def test_partial_scorers_on_messy_fixture(spark):
    """Rows-only queries in the catalogue, checked here against brute force."""
    raw = C.TB.messy_part(spark, "/root/testdata/sf0.001")
    nodes = R.distinct_values(R.normalise_long(R.melt(raw, C.MESSY_COLS, category="category"), "category"))
    rows = nodes.select("group_key", "norm").collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r.group_key, []).append(r.norm)
    for scorer in ["partial_ratio", "WRatio", "partial_token_ratio"]:
        fn = S.SCORERS[scorer]
        want = set()
        for g, vals in by_group.items():
            for a, b in itertools.combinations(sorted(vals), 2):
                if fn(a, b) >= 75:
                    want.add((g, a, b))
        got = {(r.group_key, min(r.a, r.b), max(r.a, r.b))
               for r in PR.fuzzy_edges(nodes, scorer, 75).collect()}
        assert got == want, scorer


def test_edges_oriented_by_first_occurrence(spark):
    e = PR.fuzzy_edges(_nodes(spark, ["smal ring", "small ring"]), "ratio", 75).first()
    assert (e.a, e.b) == ("smal ring", "small ring")
    assert e.u.row_id == 0 and e.v.row_id == 1


def test_token_set_compares_common_words_first(spark):
    """The common words lead both texts; in plain order they are further apart."""
    words = ["zebra anvil", "anvil zebra bolt", "bolt cog zebra", "cog zebra anvil x", "a zebra", "zebra z", "y zebra x"]
    vals = sorted({" ".join(w) for v in words for w in [v.split(), v.split()[::-1]]})
    for scorer, t in (("token_set_ratio", 70), ("token_set_ratio", 80), ("token_ratio", 75), ("WRatio", 70)):
        fn = S.SCORERS[scorer]
        want = {(a, b) for a, b in itertools.combinations(vals, 2) if fn(a, b) >= t}
        assert {(r.a, r.b) for r in PR.fuzzy_edges(_nodes(spark, vals), scorer, t).collect()} == want, (scorer, t)


LOST = [("ab", "abc", 80, "ratio"), ("ab", "abc", 80, "token_sort_ratio"),
        ("foo foo foo foo", "foob", 75, "token_set_ratio"), ("foo foo foo foo", "foob", 75, "token_ratio"),
        ("abc abc abc", "acqqqqqqqqqq", 75, "partial_token_set_ratio")]


def test_pairs_once_lost(spark):
    for a, b, t, scorer in LOST:
        if S.SCORERS[scorer](a, b) >= t:
            got = PR.fuzzy_edges(_nodes(spark, [a, b]), scorer, t).collect()
            assert [(r.a, r.b) for r in got] == [(a, b)], (a, b, scorer)


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.integers(min_value=1, max_value=100),
       st.sampled_from(sorted(S.SCORERS)))
def test_any_threshold_with_repeated_words(spark, seed, threshold, scorer):
    rnd = random.Random(seed)
    words = ["foo", "foob", "ab", "abc", "a", "bar", "rab", "oof", "x", "abcab"]
    vals = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) for _ in range(14)})
    rnd.shuffle(vals)
    fn = S.SCORERS[scorer]
    want = {(vals[i], vals[j]) for i, j in itertools.combinations(range(len(vals)), 2)
            if fn(vals[i], vals[j]) >= threshold}
    got = [(r.a, r.b) for r in PR.fuzzy_edges(_nodes(spark, vals), scorer, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_threshold_zero_links_everything(spark):
    vals = ["a", "bc", "", "xyz"]
    assert PR.fuzzy_edges(_nodes(spark, vals), "ratio", 0).count() == 6


def test_hot_keys_are_dealt_into_cells(spark, monkeypatch):
    """A group in which half of the texts share their rarest characters: equal edges, and no
    task of the join with more than twice the median's pairs."""
    rng = random.Random(9)
    vals = sorted({"zqx" + "".join(rng.choices("abcdefghij", k=4)) for _ in range(150)} |
                  {"".join(rng.choices("klmnop", k=6)) for _ in range(150)})
    nodes = _nodes(spark, vals)
    for scorer in ("ratio", "partial_ratio", "token_set_ratio"):
        want = {(r.a, r.b) for r in PR.fuzzy_edges(nodes, scorer, 70).collect()}
        with monkeypatch.context() as m:
            m.setattr(PR, "CELL_ROWS", 20)
            got = [(r.a, r.b) for r in PR.fuzzy_edges(nodes, scorer, 70).collect()]
        assert len(got) == len(set(got)) and set(got) == want, scorer


def test_cells_are_even(spark, monkeypatch):
    monkeypatch.setattr(PR, "CELL_ROWS", 50)
    rows = [(1, i) for i in range(1600)] + [(k, i) for k in range(2, 60) for i in range(20)]
    a = spark.createDataFrame(rows, "key int, x int")
    b = a.withColumnRenamed("x", "y")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        j = PR._cells(a.hint("merge"), b.hint("merge"), ["key"], len(rows))
        per = sorted(r[0] for r in j.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(per) == 1600 * 1600 + 58 * 400
    assert len(per) >= 28 and per[-1] <= 2 * per[len(per) // 2]


def test_many_texts_meet_by_what_is_left(spark):
    # the first two have all letters in common and two replacements between them, but score 80
    rnd = random.Random(5)
    words = ["abcdefghij", "jbcdefghia", "abcdefgij", "abcdefghqij", "", "a", "ab", "x\U0001F600yzzzzzz", "x\U0001F600yzzzzz"]
    words += ["".join(rnd.choice("abc") for _ in range(rnd.randint(6, 14))) for _ in range(60)]
    words = sorted(set(words))
    nodes = spark.createDataFrame([("g", w, i) for i, w in enumerate(words)], "group_key string, norm string, occ int")
    for t in (85, 75, 60):
        want = {(a, b) for a, b in itertools.combinations(words, 2) if S.ratio(a, b) >= t}
        got = [(r.a, r.b) for r in PR._pairs_indel(nodes, F.col("norm"), float(t), 10**6).collect()]
        assert len(got) == len(set(got)) and want <= set(got)
        if t == 85:
            assert set(got) == want


def test_pair_queries_read_the_table_once(spark):
    from canonspark.plans import catalogue
    found = catalogue.QUERIES["fuzzy_pairs_token_set_repeats"](spark, "/root/testdata/sf0.001")
    assert not found.inputFiles()
