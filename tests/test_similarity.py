import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canonspark.functions import batch as B
from canonspark.functions import similarity as S


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(cur[j], prev[j + 1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc d", max_size=15), st.text(alphabet="abc d", max_size=15))
def test_bit_parallel_lcs_matches_dp(a, b):
    assert S.lcs_len(a, b) == lcs_dp(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cd", max_size=12), st.text(alphabet="ab cd", max_size=12))
def test_scorers_symmetric_and_bounded(a, b):
    for name, fn in S.SCORERS.items():
        x, y = fn(a, b), fn(b, a)
        assert 0.0 <= x <= 100.0, name
        assert abs(x - y) < 1e-9, name


def test_known_values():
    assert round(S.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert S.partial_ratio("this is a test", "this is a test!") == 100.0
    assert S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100.0
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert S.ratio("", "") == 100.0
    assert S.qratio("", "") == 0.0
    assert S.wratio("", "abc") == 0.0
    assert S.token_set_ratio("", "abc") == 0.0
    assert S.partial_token_set_ratio("a b", "b c") == 100.0
    # kitten/sitting: LCS 4, lengths 6 + 7
    assert abs(S.ratio("kitten", "sitting") - (1 - 5 / 13) * 100) < 1e-12


def test_partial_ratio_windows():
    # shorter string found inside the longer one
    assert S.partial_ratio("abc", "xxabcxx") == 100.0
    # clipped window at the start
    assert S.partial_ratio("abcd", "cdxxxxxx") == S.ratio("abcd", "cd")


def test_unknown_scorer_rejected():
    with pytest.raises(ValueError):
        S.check_scorer("partial_ratio_alignment")


def _texts(seed, alphabet, longest, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("alphabet,longest", [("ab c", 9), ("abcdefgh é\U0001f600", 30), ("abc", 70), ("ab", 200)])
def test_batched_kernels_equal_the_definitions(alphabet, longest):
    """Texts of one to several machine words, all sizes in one batch."""
    a, b = _texts(1, alphabet, longest), _texts(2, alphabet, longest)
    assert B.lcs_lengths(a, b).tolist() == [lcs_dp(x, y) for x, y in zip(a, b)]
    assert B.partial_scores(a, b).tolist() == [S.partial_ratio(x, y) for x, y in zip(a, b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc ", max_size=14), st.text(alphabet="abc ", max_size=14)), max_size=6))
def test_batched_kernels_on_small_batches(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert B.lcs_lengths(a, b).tolist() == [lcs_dp(x, y) for x, y in pairs]
    assert B.partial_scores(a, b).tolist() == [S.partial_ratio(x, y) for x, y in pairs]


def test_small_chunks(monkeypatch):
    a, b = _texts(3, "abcd", 90), _texts(4, "abcd", 90)
    whole = B.lcs_lengths(a, b).tolist(), B.partial_scores(a, b).tolist()
    monkeypatch.setattr(B, "CELLS", 100)
    assert (B.lcs_lengths(a, b).tolist(), B.partial_scores(a, b).tolist()) == whole


def test_score_columns_equal_the_definitions(spark):
    rng = random.Random(5)
    vocabulary = ["ring", "rings", "red", "gear", "é", "a", "b", "blue", "brand4", "brand14"]
    values = ["", " ", "a a", "\t"] + [rng.choice([" ", "  ", "\t"]).join(rng.choices(vocabulary, k=rng.randrange(1, 7)))
                                     for _ in range(60)]
    rows = [(x, y) for x in values for y in rng.choices(values, k=12)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", *[S.score_column(n, "a", "b").alias(n) for n in S.SCORERS]).collect()
    for r in got:
        for name, fn in S.SCORERS.items():
            assert r[name] == fn(r["a"], r["b"]), (name, r["a"], r["b"])
    unknown = spark.createDataFrame([("a", None), (None, None)], "a string, b string")
    assert [tuple(r) for r in unknown.select(S.lcs_udf("a", "b"), S.partial_udf("a", "b")).collect()] == [(None, None)] * 2
