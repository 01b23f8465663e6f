from pyspark.sql import functions as F

from canonspark.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first()["r"]


def test_normalize_edge_rows(spark):
    # strip comes before punctuation removal; underscore and accents kept
    assert _one(spark, T.normalize("v"), "- a") == " a"
    assert _one(spark, T.normalize("v"), "A_b-É!") == "a_bé"
    assert _one(spark, T.normalize("v"), "!!") == ""
    assert _one(spark, T.normalize("v"), None) is None


def test_numeric_text(spark):
    cases = {"-5": False, "1.5": True, "1.2.3": False, "5.": True, "1e5": False, ".": False}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.n for r in df.select("v", T.is_numeric_text("v").alias("n")).collect()}
    assert got == cases


def test_words_and_strip(spark):
    assert _one(spark, T.words("v"), "  a \t b  ") == ["a", "b"]
    assert _one(spark, T.words("v"), "   ") == []
    assert _one(spark, T.strip("v"), "  x \n") == "x"


def test_to_bool(spark):
    df = spark.createDataFrame([(" Yes",), ("f",), ("1",)], "v string")
    assert [r.b for r in df.select(T.to_bool("v").alias("b")).collect()] == [True, False, True]


def test_char_ngrams(spark):
    got = _one(spark, T.char_ngrams(F.col("v")), "abcd")
    assert got == ["ab", "bc", "cd", "abc", "bcd", "abcd"]
    assert _one(spark, T.char_ngrams(F.col("v")), "a") == []


def test_request_parameters():
    import pytest

    from canonspark.plans import params as P
    assert P.parse_bool("false") is False and P.parse_bool(" Yes") is True   # D3: no bool("false")
    with pytest.raises(ValueError):
        P.parse_bool("maybe")
    assert P.parse_threshold("80") == 80
    with pytest.raises(ValueError):
        P.check_request(["a"], match_mode="partial_ratio_alignment")
    with pytest.raises(ValueError):
        P.check_request([])


def test_signed_numeric_option(spark):
    df = spark.createDataFrame([("-5",), ("1e5",), ("+.5e-2",), ("x",)], "v string")
    got = [r.n for r in df.select(T.is_numeric_text("v", signed=True).alias("n")).collect()]
    assert got == [True, True, True, False]


def test_separators_are_whitespace(spark):
    r = spark.createDataFrame([("\x1c a\x1eb \x1f",)], "v string").select(T.strip("v"), T.words("v"), T.normalize("v")).first()
    assert (r[0], list(r[1]), r[2]) == ("a\x1eb", ["a", "b"], "a\x1eb")
