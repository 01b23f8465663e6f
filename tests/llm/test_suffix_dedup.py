import hashlib
import random
from collections import Counter

import pytest

from canonspark.llm import suffix_dedup as S


def brute(texts, window):
    """Every window of every text, counted."""
    data = [b"" if t is None else t.encode() for t in texts]
    seen = Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, x in zip(b, gone) if not x)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, window, gram, bucket_rows=20_000, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumn("k1", F.lit("x")).withColumn("spans", F.lit(None)).withColumn("repeats", F.lit(3))
    got = S.remove_repeats(df, window, gram, bucket_rows).collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    return [(r["repeats"]["n_bytes"], r["repeats"]["n_removed"], r["repeats"]["n_spans"],
             hashlib.sha256(bytes(r["repeats"]["kept"])).hexdigest()) for r in got]


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    passage = " ".join(rng.choice(vocab) for _ in range(25))
    texts = []
    for i in range(n):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, words))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        if i % 5 == 0 and texts and texts[-1]:
            copy = list(texts[rng.randrange(len(texts))] or "")
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = "#"
            body = ["".join(copy)]
        texts.append(" ".join(body))
    return texts + [None, "", "ab" * 90, "x" * 200, "x" * 41, passage, passage]


@pytest.mark.parametrize("seed,bucket_rows", [(1, 20_000), (2, 40), (3, 5)])
def test_equals_counting_every_window(spark, seed, bucket_rows):
    texts = corpus(seed, 60)
    assert run(spark, texts, 40, 8, bucket_rows) == brute(texts, 40)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [], 40, 8) == []
    texts = ["a" * 30 + "b" * 50, "c" * 10 + "b" * 50, None]
    assert run(spark, texts, 40, 8, extra=True) == brute(texts, 40)


def test_null_and_repeated_ids(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(40))
    df = spark.createDataFrame([(None, text), (5, text[:50]), (5, "zz" + text[30:]), (5, "zz" + text[30:])],
                               "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["repeats"] for r in S.remove_repeats(df, 20, 8).collect()}
    assert got[(5, "zz" + text[30:])]["n_removed"] == len(text) - 28
    assert got[(None, text)]["n_removed"] == len(text)
    assert got[(5, text[:50])]["n_removed"] == 50


@pytest.mark.parametrize("bucket_rows", [20_000, 5])
def test_passages_equal_counting_every_run_of_words(spark, bucket_rows):
    """Bytes of 16-word runs that start anywhere else leave; the byte window is out of reach."""
    texts = corpus(4, 60)
    pairs = [[(m.group(), *m.span()) for m in S._WORD.finditer((t or "").encode())] for t in texts]
    runs = [[tuple(w for w, _, _ in p[i:i + 16]) for i in range(len(p) - 15)] for p in pairs]
    seen = Counter(r for x in runs for r in x)
    want = []
    for t, p, x in zip(texts, pairs, runs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i, r in enumerate(x):
            if seen[r] > 1:
                gone[p[i][1]:p[i + 15][2]] = b"\1" * (p[i + 15][2] - p[i][1])
        want.append((sum(gone), bytes(c for c, g in zip(b, gone) if not g)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(S.remove_repeats(df, 100_000, 32, bucket_rows, words=16).collect(), key=lambda r: r["doc_id"])
    assert [(r["repeats"]["n_removed"], bytes(r["repeats"]["kept"])) for r in got] == want
    assert sum(n > 0 for n, _ in want) > 5


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    """Anchors of a text that is longer than a part; nothing is lost where parts meet."""
    from canonspark.llm import anchors
    monkeypatch.setattr(anchors, "PART", 70)
    texts = corpus(9, 12)
    import numpy as np
    for t in texts:
        b = np.frombuffer(S.encode(t), np.uint8)
        at, first, last, _ = anchors.window_anchors(b, 24, 8)
        served = sorted(i for x, y in zip(first.tolist(), last.tolist()) for i in range(x, y + 1))
        assert served == list(range(max(0, len(b) - 24 + 1)))
        assert all(x <= p and p + 8 <= y + 24 for p, x, y in zip(at.tolist(), first.tolist(), last.tolist()))
