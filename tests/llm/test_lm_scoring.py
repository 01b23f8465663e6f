import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canonspark.llm import gru, lm_scoring as M
from canonspark.llm.textops import space_words

SMALL = gru.Shape(short=8, per_class=4, others=3, embed=3, hidden=4)


def base(rows):
    """Counts and unigram scores, spelled out."""
    out_of = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    tokens = [[*space_words(r[1]), M.END] for r in rows]
    c = Counter(w for t, h in zip(tokens, out_of) if not h for w in t)
    total, size = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), total,
             sum(math.log10((c[w] + 1) / (total + size + 1)) for w in t)) for t, h in zip(tokens, out_of)]


def test_base_columns_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, None), (10 ** 6, ""), (5, "ZZ zz"), (5, "ZZ zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as word", "2 as n")
    want = sorted(((r[0] is None, r[0] or 0), b) for r, b in zip(rows, base(rows)))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0),
                  (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]), r["score"])
                 for r in M.score(df, head=50).collect())
    assert len(got) == len(want)
    for (k, a), (k2, b, s) in zip(want, got):
        assert k == k2 and a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9), k
        assert math.isfinite(s) and s < 0


def test_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = M.score(docs).where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1]


def test_every_training_document_is_learned_from(spark):
    """A table of one document moves the weights, whatever its id."""
    v = M.Vocabulary([(b"w%d" % i, 30 - i) for i in range(14)] + [(M.END, 9)], 400, 20, SMALL)
    first = gru.pack(gru.start(SMALL, v.word_log_p, v.class_log_p))
    for doc_id in (1, 2, 3, 4, 5, None):
        codes = v.numbers([b"w1", b"w2", b"w3", b"w1", b"w2", b"zz", M.END]).astype("<u2").tobytes()
        one = spark.createDataFrame([(0, 1, doc_id, False, bytearray(codes))],
                                    "shard long, place long, doc_id long, held_out boolean, codes binary")
        assert not np.array_equal(M.train(one, v, 1), first), doc_id


def test_score_does_not_depend_on_partitions(spark, monkeypatch):
    """Several shards, the table in 1, 4 and 8 partitions."""
    monkeypatch.setattr(M, "SHARD_WORDS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [{r["doc_id"]: r["score"] for r in M.score(docs.repartition(n)).collect()} for n in (1, 4, 8)]
    for other in got[1:]:
        assert got[0].keys() == other.keys()
        assert all(math.isclose(v, other[k], rel_tol=1e-5) for k, v in got[0].items())


def test_very_long_text_beside_short_ones():
    """A million words in one lane and 300 short texts: memory is that of the words and a window."""
    import tracemalloc
    v = M.Vocabulary([(b"w%d" % i, 30 - i) for i in range(14)] + [(M.END, 9)], 400, 20, SMALL)
    model = gru.Model(gru.start(SMALL, v.word_log_p, v.class_log_p), SMALL)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 11, 1_000_000).astype(np.uint16)] + [rng.integers(0, 11, 20).astype(np.uint16)] * 300
    tracemalloc.start()
    lane, most = gru.Streams(docs, 512), 0
    for i, (before, word, doc) in enumerate(lane.windows(64)):
        if i > 20:
            break
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200_000_000
    short = [d[:5000] for d in docs[:3]]
    assert np.allclose(model.score(short), [model.score([d])[0] for d in short], rtol=1e-4)


def test_model_is_a_distribution():
    """The probabilities of all words and one unknown word sum to one, after any text."""
    words = [(b"w%d" % i, 40 - i) for i in range(20)] + [(M.END, 9)]
    total, size = sum(c for _, c in words) + 30, len(words) + 7   # seven words beyond the head
    v = M.Vocabulary(words, total, size, SMALL)
    model = gru.Model(gru.start(SMALL, v.word_log_p, v.class_log_p), SMALL)
    prefix = v.numbers([b"w1", b"w9", b"zzz"])
    start = model.score([prefix])[0]

    def prob(number, inside):
        return math.exp(model.score([np.append(prefix, np.int32(number))])[0] - start + inside)

    total_p = sum(prob(v.number[v.place[w]], v.share[v.place[w]]) for w, _ in words)
    # the words beyond the head have counts that sum to 30, and one word is unknown
    total_p += prob(v.rest, 0.0) * (30 + 7 + 1) / v.rest_total
    assert math.isclose(total_p, 1.0, rel_tol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    v = M.Vocabulary([(b"w%d" % i, 30 - i) for i in range(14)], 400, 20, SMALL)
    docs = [rng.integers(0, SMALL.short + SMALL.others, n).astype(np.int32) for n in (5, 3, 4)]
    p = {k: x.astype(np.float64) for k, x in gru.start(SMALL, v.word_log_p, v.class_log_p).items()}
    p["E"] *= 10
    model = gru.Model(p, SMALL)
    before, word, _ = next(gru.Streams(docs, 2).windows(100))
    h = np.zeros((word.shape[1], SMALL.hidden))

    def loss():
        states, _, _ = model._steps(before, h, False)
        ok = word >= 0
        return -model.log_p(states[ok], word[ok])[0].sum() / math.sqrt(ok.sum())

    states, _, saved = model._steps(before, h, True)
    grads = model._back(before, word, states, saved)
    for k, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
            old = p[k][at]
            p[k][at] = old + 1e-3
            up = loss()
            p[k][at] = old - 1e-3
            down = loss()
            p[k][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * max(1.0, abs(g[at])), (k, at)


def test_state_is_carried_and_documents_do_not_mix():
    v = M.Vocabulary([(b"w%d" % i, 30 - i) for i in range(14)], 400, 20, SMALL)
    model = gru.Model(gru.start(SMALL, v.word_log_p, v.class_log_p), SMALL)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (1, 70, 3, 200, 9)]
    together = model.score(docs, lanes=2, steps=7)
    alone = [model.score([d], lanes=1, steps=1000)[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def test_empty_table(spark):
    assert M.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_stay_exact_beside_null_ones(spark):
    """Texts and numbers stay in Arrow's arrays; by way of pandas, ids beside a null one became doubles."""
    ids = [2**53 + 1, None, 2**62 + 3, -2**53 - 1]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string").coalesce(1)
    got = [r["doc_id"] for r in M.score(docs, head=2, shape=SMALL).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)


def test_coded_rows_hold_every_word(spark):
    """Numbers of the head's words, and each other word with its count, text by text."""
    texts = ["a b b zz a yy zz", "", None, "  ", "xx", "b A\tyy"]
    counts = M.word_counts(spark.createDataFrame([(t,) for t in texts[:1]], "text string"))
    v = M.vocabulary(counts, 3, SMALL)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array([5, None, 7, 8, 9, 10]), pa.array([False] * 6), pa.array(range(6)), pa.array(texts)],
        names=["rid", "doc_id", "held_out", "place", "text"])
    for vocab in (v, M.Vocabulary([], 0, 0, SMALL)):
        rows = pa.Table.from_batches(M._coder(SimpleNamespace(value=vocab), 4)(iter([batch]))).to_pylist()
        assert [r["doc_id"] for r in rows] == [5, None, 7, 8, 9, 10] and [r["shard"] for r in rows] == [0, 1, 2, 3, 0, 1]
        for r, t in zip(rows, texts):
            words = [*space_words(t), M.END]
            assert np.frombuffer(r["codes"], "<u2").tolist() == vocab.numbers(words).tolist()
            rest = Counter(w for w in words if w not in vocab.place)
            assert dict(zip(r["words"], r["times"])) == rest and len(r["words"]) == len(rest)
            assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in vocab.place for w in words)
