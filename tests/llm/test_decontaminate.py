import random

from canonspark.llm import decontaminate as D
from canonspark.llm.textops import alnum_words


def brute(text, items, size):
    words = alnum_words(text)
    hit, found = set(), set()
    for item_id, t in items:
        ws = alnum_words(t)
        k = min(size, len(ws))
        for w in {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if ws else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i:i + k]) == w:
                    hit |= set(range(i, i + k))
                    found.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "ab", "b", "abc", "é", "ba", "c1", "the", "9", "zz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 7)))) for i in range(12)]
    items += [(None, "the zz"), (3, None), (12, "Ab, the--ZZ!"), (4, items[4][1])]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", "!!!", "aB\tthe zz", "the zz " * 300, items[5][1]]
    return texts, items


def test_equals_brute_force_in_one_and_many_parts(spark):
    for seed, part in ((1, 100_000), (2, 3)):
        texts, items = case(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        docs = docs.selectExpr("*", "1 as items", "'x' as spans", "2 as benchmark_hits")
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as pattern")
        got = {r["doc_id"]: r["benchmark_hits"] for r in D.contamination(docs, bench, 4, part).collect()}
        for i, t in enumerate(texts):
            g = got[i]
            assert (g["n_words"], g["n_hit"], list(g["items"]), g["contaminated"]) == brute(t, items, 4), (seed, t)


def test_one_search_a_part(spark):
    """Each part's plan evaluates one UDF, and the rows before it are a table."""
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 x")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} w{i + 3}") for i in range(60)], "item_id long, text string")
    for part, parts in ((100, 1), (5, 12)):
        df = D.contamination(docs, bench, 4, part)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, parts
        assert [list(r["benchmark_hits"]["items"]) for r in df.collect()] == [["1", "2"]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r["benchmark_hits"]["n_hit"] for r in D.contamination(one, bench).collect()] == [0, 0]


def test_searcher_equals_scan():
    rng = random.Random(5)
    for _ in range(200):
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 80)))
        pats = {bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 9))): 0 for _ in range(6)}
        got = sorted((s, p) for w in D.banded(pats) for s, p, _ in w.find(text))
        assert got == sorted((i, p) for p in pats for i in range(len(text)) if text.startswith(p, i))
