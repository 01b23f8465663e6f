import random

import numpy as np
import pytest

from canonspark.llm import near_dedup as N
from canonspark.llm.components import components
from canonspark.llm.shingles import WordHashes, shingle_set
from canonspark.llm.textops import space_words


def brute(rows, k, least):
    """Every pair compared on plain sets; (set size, smallest id reachable)."""
    sets = []
    for i, t in rows:
        w = space_words(t)
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return [(len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for edits in [0] * 6 + [1] * 25 + [3] * 25 + [6] * 15:   # a hot group around the threshold
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    for _ in range(40):
        t = [rng.choice(vocab) for _ in range(rng.randint(1, 80))]
        texts.append(" ".join(t))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "X"
            texts.append("\t".join(t).upper())
    texts += [None, "", " \n", "a b", "A  b", "a b c", "one", "One ", "x " * 3000, "x " * 2000 + "y"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,block,words", [(1, 4096, 4), (2, 8, 5)])
def test_equals_comparing_every_pair(spark, seed, block, words):
    rows = corpus(seed) + [(None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = df.selectExpr("*", "1 as id", "'x' as key", "2 as component")
    got = N.near_duplicates(df, words=words, threshold=80, block=block).collect()
    assert len(got) == len(rows)
    want = {i: w for (i, _), w in zip(rows, brute(rows, words, 80)) if i is not None}
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_empty_table_and_repeated_rows(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (5, "other words here")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [
        (3, 3, 3), (5, 1, 5), (5, 3, 3), (5, 3, 3)]


def test_sketches_rule_out_with_proof():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 2000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.5, 0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 200))).astype(np.uint64)]))
        if len(b) == 0:
            continue
        x, y = (np.frombuffer(N.parity_sketch(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        d = int(np.bitwise_count(N.fold_sketch(x, size) ^ N.fold_sketch(y, size)).sum())
        both = len(np.intersect1d(a, b))
        assert d <= len(a) + len(b) - 2 * both
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert not N.ruled_out(len(a), len(b), d, 80)


def test_tensored_keys_find_pairs_at_the_threshold():
    """Pairs at 0.8 share a key (a pair of bands) in all of many trials."""
    rng = np.random.default_rng(1)
    mult = N._multipliers(2 * N.TABLES * N.ROWS)
    for _ in range(300):
        common = rng.integers(0, 2**63, 80).astype(np.uint64)
        bands = []
        for _ in range(2):
            s = np.concatenate([common, rng.integers(0, 2**63, 10).astype(np.uint64)])
            bands.append(N._minhashes(s, mult).reshape(2 * N.TABLES, N.ROWS))
        same = (bands[0] == bands[1]).all(axis=1)
        assert same[:N.TABLES].any() and same[N.TABLES:].any()


def test_shingles_and_bounded_word_table():
    h = WordHashes(limit=3)
    words = space_words("A b\tc d  a B c D e")
    assert len(shingle_set(words, h, 4)) == len({tuple(words[i:i + 4]) for i in range(6)})
    assert len(h) <= 3 and len(shingle_set([], h, 4)) == 0
    assert shingle_set([b"a", b"b"], h, 4)[0] != shingle_set([b"b", b"a"], h, 4)[0]


def test_components_of_a_long_line(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components(e.limit(0)).count() == 0
