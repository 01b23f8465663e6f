"""G1 suggestions, J3 overrides, summary and acceptance (FIXTURES section 4)."""

from pyspark.sql import functions as F

from canonspark.operators import spell as SP
from canonspark.operators import suggest as SG
from canonspark.plans import cleaning as CL

SCHEMA = "group_key string, norm string, occ struct<col_ord:int,row_id:bigint>, n bigint, " \
         "cluster_id long, cluster_tag string"


def _clustered(spark, values, cid=1):
    """values: list of (norm, first_row, n) in one cluster."""
    rows = [("g", v, (0, r), n, cid, f"cluster_{cid}") for v, r, n in values]
    return spark.createDataFrame(rows, SCHEMA)


def _dict(spark, words):
    return spark.createDataFrame([(w, f) for w, f in words], "word string, freq long")


def test_majority_tie_first_seen(spark):
    # b, a, a, b: tie broken by first occurrence -> b, confidence 0.5
    c = _clustered(spark, [("b", 0, 2), ("a", 1, 2)])
    s = SG.suggest(c).first()
    assert (s.suggestion, s.suggestion_mode, s.confidence, s.size) == ("b", "majority", 0.5, 4)


def test_single_member(spark):
    s = SG.suggest(_clustered(spark, [("x", 0, 1)])).first()
    assert (s.suggestion, s.suggestion_mode, s.confidence) == ("x", "single_member", 1.0)


def test_all_distinct_dictionary_word(spark):
    c = _clustered(spark, [("colour", 0, 1), ("colur", 1, 1), ("coluor", 2, 1)])
    s = SG.suggest(c, _dict(spark, [("colour", 10)])).first()
    assert (s.suggestion, s.suggestion_mode, s.confidence) == ("colour", "spell_checker", 0.33)


def test_all_distinct_corrected_vote(spark):
    c = _clustered(spark, [("colur", 0, 1), ("coluor", 1, 1)])
    s = SG.suggest(c, _dict(spark, [("colour", 10)])).first()
    assert (s.suggestion, s.suggestion_mode, s.confidence) == ("colour", "spell_checker", 0.9)


def test_damerau_unrestricted():
    assert SP.damerau_levenshtein("ca", "abc") == 2
    assert SP.damerau_levenshtein("ab", "ba") == 1
    assert SP.damerau_levenshtein("", "abc") == 3


def test_spell_tiers_and_ties(spark):
    words = spark.createDataFrame([("helo",), ("zzzzzz",), ("12.5",), ("wrld",), ("world",)], "word string")
    d = _dict(spark, [("hello", 5), ("help", 5), ("world", 3), ("hero", 9)])
    got = {r.word: (r.correction, r.tier) for r in SP.correct_words(words, d).collect()}
    # distance 1 beats distance 2; among distance-1 the most frequent, ties alphabetical
    assert got["helo"] == ("hero", 1)
    assert got["zzzzzz"] == ("zzzzzz", None)
    assert got["12.5"] == ("12.5", None)
    assert got["wrld"] == ("world", 1)
    assert got["world"] == ("world", 0)


def _raw(spark):
    rows = [(0, "A", "Acme"), (1, "A", "acme"), (2, "A", "ACME!"), (3, "B", "Zed"),
            (4, None, "acme"), (5, "B", None), (6, "A", "  ")]
    return spark.createDataFrame(rows, "row_id long, cat string, name string")


def test_apply_direct_with_null_override(spark):
    g = CL.group_in_column(_raw(spark), ["name"])
    m = g.members().where(F.col("member_idx") == 0).select("group_key", "cluster_id", "member_idx")
    ov = m.withColumn("value", F.lit(None).cast("string"))
    a = CL.apply_cleaning(g, ov)
    cleaned = {r.row_id: r.name_cleaned for r in a.cleaned.collect()}
    # member 0 of each cluster overridden with NULL: the NULL wins
    assert cleaned[0] is None and cleaned[3] is None
    assert cleaned[1] == "acme" and cleaned[2] == "acme" and cleaned[4] == "acme"
    assert cleaned[5] is None            # NULL cell stays NULL
    assert cleaned[6] == "  "            # blank is not clustered in direct mode
    s = a.summary.first()
    assert s.manual_corrections == 2 and s.num_of_clusters == 2
    assert s.total_values == 5 and s.num_of_before_unique == 4


def test_apply_category_keeps_null_category(spark):
    g = CL.group_by_category(_raw(spark), ["name"], "cat")
    a = CL.apply_cleaning(g)
    cleaned = {r.row_id: r.name_cleaned for r in a.cleaned.collect()}
    assert cleaned[4] == "acme" and cleaned[0] == "acme"
    assert cleaned[6] == ""               # category mode keeps the blank, normalised
    rows = {r.column: r for r in a.summary.collect()}
    assert rows["A"].manual_corrections is None
    # the '' cluster of A is not counted (empty suggestion)
    assert rows["A"].num_of_after_unique == 1


def test_acceptance_ratio(spark):
    sugg = spark.createDataFrame(
        [("g", 1, "x", "majority", 1), ("g", 2, "y", "majority", 1), ("g", 3, "z", "custom", 1)],
        "group_key string, cluster_id int, suggestion string, suggestion_mode string, size long")
    stats = spark.createDataFrame([("g", 3, 3)], "group_key string, total_values long, num_of_before_unique long")
    from canonspark.operators import summary as SM
    r = SM.summarize(sugg, stats, "direct").first()
    assert r.acceptance_ratio == 66.7
    empty = SM.summarize(sugg.limit(0), stats, "direct",
                         groups=spark.createDataFrame([("g",)], "group_key string")).first()
    assert empty.acceptance_ratio == 0.0 and empty.num_of_clusters == 0


def test_restore_case_option(spark):
    g = CL.group_in_column(_raw(spark), ["name"])
    got = {r.suggestion for r in g.restored_suggestions().collect()}
    # 'acme' members: Acme, acme, ACME!, acme -> raw 'acme' twice wins; 'zed' -> 'Zed'
    assert got == {"acme", "Zed"}


def test_last_override_wins_and_no_row_is_repeated(spark):
    raw = _raw(spark)
    g = CL.group_in_column(raw, ["name"])
    first = g.members().where("member_idx = 0").select("group_key", "cluster_id", "member_idx")
    ov = (first.withColumn("value", F.lit("early")).withColumn("entry", F.lit(1))
          .unionByName(first.withColumn("value", F.lit(None).cast("string")).withColumn("entry", F.lit(2)))
          .unionByName(first.withColumn("value", F.lit("late")).withColumn("entry", F.lit(3))))
    so = g.suggestions.select("group_key", "cluster_id")
    so = (so.withColumn("suggestion", F.lit("x")).withColumn("suggestion_mode", F.lit("custom")).withColumn("entry", F.lit(1))
          .unionByName(so.withColumn("suggestion", F.lit("y")).withColumn("suggestion_mode", F.lit("llm_suggest"))
                       .withColumn("entry", F.lit(2))))
    a = CL.apply_cleaning(g, ov, so)
    got = {r.row_id: r.name_cleaned for r in a.cleaned.collect()}
    assert len(got) == a.cleaned.count() == raw.count()
    assert got[0] == got[3] == "late" and got[1] == got[2] == "y"
    s = a.summary.first()
    assert s.manual_corrections == 2 and s.num_of_llm == 5 and s.num_of_global_manual == 0


def test_row_ids_must_be_unique(spark):
    import pytest
    rows = [(0, "acme"), (0, "zzzz"), (1, "acme")]
    with pytest.raises(ValueError, match="row_id must be unique"):
        CL.group_in_column(spark.createDataFrame(rows, "row_id long, name string"), ["name"])


def test_category_mode_leaves_numbers_and_long_texts(spark):
    import pytest
    rows = [(i, "A", "acme" if i % 2 else "acmee", i % 3, "long text " * 9) for i in range(6)]
    raw = spark.createDataFrame(rows, "row_id long, cat string, name string, qty int, note string")
    out = CL.apply_cleaning(CL.group_by_category(raw, ["name", "qty", "note"], "cat")).cleaned
    assert [c for c in out.columns if c.endswith("_cleaned")] == ["name_cleaned"]
    with pytest.raises(ValueError):
        CL.group_by_category(raw, ["qty"], "cat")
    with pytest.raises(ValueError):
        CL.group_by_category(raw, [], "cat")


def test_columns_with_dots(spark):
    raw = spark.createDataFrame([(0, "Acme", "c"), (1, "acme", "c")], "row_id long, `a.b` string, `k.1` string")
    got = CL.apply_cleaning(CL.group_in_column(raw, ["a.b"])).cleaned.collect()
    assert [r["a.b_cleaned"] for r in got] == ["acme", "acme"]
    got = CL.apply_cleaning(CL.group_by_category(raw, ["a.b"], "k.1")).cleaned.collect()
    assert [r["a.b_cleaned"] for r in got] == ["acme", "acme"]


def test_spelling_of_long_words(spark):
    import random
    rnd = random.Random(1)
    known = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (4, 12, 19, 20, 21, 22, 30, 41, 400) for _ in range(6)]

    def edited(w):
        w = list(w)
        for _ in range(2):
            i = rnd.randrange(len(w) - 1)
            kind = rnd.randrange(4)
            if kind == 0:
                w[i], w[i + 1] = w[i + 1], w[i]
            elif kind == 1:
                del w[i]
            elif kind == 2:
                w.insert(i, rnd.choice("abcd"))
            else:
                w[i] = rnd.choice("abcd")
        return "".join(w)

    asked = sorted({edited(w) for w in known for _ in range(4)} - set(known))
    d = _dict(spark, [(w, 1) for w in sorted(set(known))])
    got = {r.word: (r.correction, r.tier) for r in SP.correct_words(
        spark.createDataFrame([(w,) for w in asked], "word string"), d).collect()}
    for w in asked:
        near = sorted((SP.damerau_levenshtein(w, k), k) for k in set(known) if abs(len(k) - len(w)) <= 2)
        if near and near[0][0] <= 2:
            assert got[w] == (near[0][1], near[0][0]), w


def test_transpositions_among_the_edits(spark):
    # one edit or two by transpositions, with and without another edit between the letters
    words = {"abdcef": "abcdef", "badcef": "abcdef", "bxadcef": None, "abdxcef": "abcdef", "fbcdea": "abcdef",
             "abcfed": "abcdef", "abdcxf": "abcdef", "defabc": None}
    dictionary = spark.createDataFrame([("abcdef", 5)], "word string, freq long")
    got = {r.word: (r.correction, r.tier) for r in SP.correct_words(
        spark.createDataFrame([(w,) for w in words], "word string"), dictionary).collect()}
    for w in words:
        d = SP.damerau_levenshtein(w, "abcdef")
        assert got[w] == (("abcdef", d) if d <= 2 else (w, None)), w


def test_few_exact_distances(spark, monkeypatch):
    # replaced letters are told by the bounded distance alone
    def none(*_):
        raise AssertionError("no exact distance is needed here")

    monkeypatch.setattr(SP, "damerau_levenshtein", none)
    monkeypatch.setattr(SP, "dl_udf", lambda a, b: F.raise_error(F.lit("no exact distance is needed here")).cast("int"))
    words = spark.createDataFrame([("abcdxf",), ("abxdyf",), ("abcde",), ("qrcdst",)], "word string")
    dictionary = spark.createDataFrame([("abcdef", 5)], "word string, freq long")
    got = {r.word: (r.correction, r.tier) for r in SP.correct_words(words, dictionary).collect()}
    assert got == {"abcdxf": ("abcdef", 1), "abxdyf": ("abcdef", 2), "abcde": ("abcdef", 1), "qrcdst": ("qrcdst", None)}


def test_the_plan_of_corrections_is_short(spark):
    # the driver keeps the plan of every query that has run
    c = _clustered(spark, [("colur", 0, 1), ("coluor", 1, 1)])
    s = SG.suggest(c, _dict(spark, [("colour", 10)]))
    assert s.first().suggestion == "colour"
    assert s._jdf.queryExecution().sparkPlan().toString().count("\n") < 90
