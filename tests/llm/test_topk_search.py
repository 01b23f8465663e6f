import numpy as np

from canonspark.llm import topk_search as T


def brute(vecs, asked, k):
    out = []
    for qid in asked:
        q = dict(vecs)[qid]
        s = sorted((-int(np.dot(q, v)), i) for i, v in vecs if i != qid and len(v) == len(q))
        out += [(qid, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_index_keeps_every_member_of_the_best():
    rng = np.random.default_rng(0)
    for dims, spread in ((1, 5), (6, 3), (16, 200)):
        x = rng.integers(-spread, spread + 1, (300, dims))
        index = T.ImpactIndex(x, 8)
        for q in [*rng.integers(-spread, spread + 1, (20, dims)), np.zeros(dims, np.int64)]:
            rows, score = index.search(q, 10, np.zeros(300, dtype=bool))
            exact = x @ q
            kth = np.sort(exact)[-10]
            assert set(np.flatnonzero(exact >= kth)) <= set(rows.tolist())
            assert sorted(exact)[-10:] == sorted(score)[-10:]


def test_segments_hold_every_posting_once_in_order_of_level():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 51, (200, 4))
    index = T.ImpactIndex(x, 8)
    for j in range(8):
        mine = np.flatnonzero(index.list == j)
        assert (np.diff(index.level[mine]) < 0).all()
        assert index.first[mine[0]] == 0 and index.last[mine[-1]] == 200
        assert sorted(index.postings[j].tolist()) == list(range(200))
        for s in mine:
            rows = index.postings[j, index.first[s]:index.last[s]]
            impact = x[rows, j] - x[:, j].min() if j < 4 else x[:, j - 4].max() - x[rows, j - 4]
            assert (index.at[s] <= impact).all() and (impact <= index.top[s]).all()


def test_rows_are_given_up_and_few_postings_are_touched():
    """Vectors in clusters: a good part of the postings of the query's lists is never added."""
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 300, (50, 32))
    x = (centre[rng.integers(0, 50, 5000)] + rng.normal(0, 30, (5000, 32))).astype(np.int64)
    index = T.ImpactIndex(x)
    for q in x[:8]:
        index.touched = 0
        rows, _ = index.search(q, 10, np.zeros(5000, dtype=bool))
        assert len(rows) < 500 and index.touched < 0.75 * 5000 * 32


def test_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    vecs = [(int(i), [int(z) for z in rng.integers(-3, 4, 5)]) for i in range(230)]
    vecs += [(1000, vecs[0][1]), (1001, vecs[0][1]), (1002, [0, 0, 0, 0, 0]), (1003, [7])]
    df = spark.createDataFrame(vecs, "vec_id long, v array<long>").selectExpr("*", "1 as shard", "2 as block")
    asked = [0, 100, 200, 1000, 1002]
    for shard in (4096, 50):
        got = T.top_k(df, df.where(df.vec_id.isin(asked)), 10, shard).collect()
        assert sorted(map(tuple, got)) == brute(vecs, asked, 10)


def test_left_out_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [nan, 1.0]), (2, None), (3, [inf, 0.0]), (4, [0.1, None]), (None, [1.0, 1.0]),
            (5, [-0.0001, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = T.integer_vectors(df)
    assert sorted((r["vec_id"], list(r["v"])) for r in v.collect()) == [(0, [512, -256]), (5, [-1, 1024])]
    got = T.top_k(v, v.where("vec_id = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, -512 - 256 * 1024)]
    assert T.top_k(v.limit(0), v.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    vecs = [(i, [(-1) ** i * (2 ** 28 + 7 * i), i, 3]) for i in range(40)]
    df = spark.createDataFrame(vecs, "vec_id long, v array<long>")
    got = T.top_k(df, df.where("vec_id in (0, 7)"), 5).collect()
    assert sorted(map(tuple, got)) == brute(vecs, [0, 7], 5)


def test_components_of_any_size(spark):
    """A large component doesn't cost its vector's other scores; repeated ids are candidates each."""
    rows = [(0, [3e6, 0.0]), (1, [0.0, 1.0]), (100, [0.0, 2.0]), (7, [-3e30, 0.5]), (7, [0.0, 0.25]), (8, [1e30, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = T.integer_vectors(df)
    got = T.top_k(v, v.where("vec_id = 100")).collect()
    assert [tuple(r)[2:] for r in got] == [(1, 2048 * 1024), (7, 2048 * 512), (7, 2048 * 256), (0, 0), (8, -2048 * 1024)]
    import pytest
    with pytest.raises(Exception, match="64 bits"):  # the score of 0 with 8
        T.top_k(v, v.where("vec_id = 0"), 3).collect()
