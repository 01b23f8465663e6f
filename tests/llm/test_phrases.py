import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canonspark.llm import phrases as P


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def counts(rows, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def brute(rows, least=30, top=2000):
    f, n = counts(rows)
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(100 * f[lang, q] >= 80 * a for l2, q in f if l2 == lang and len(q) > len(p)
               and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
                  for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


WORDS = ["the", "The", "Of", "é", "É", "a b", "x\x00y", "new", "york", "stock", "exchange", "in", "-", " ", "zz"]


def texts(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(1, 40)):
            out.append(rng.choice(["New York Stock Exchange", "of the", rng.choice(WORDS), rng.choice(WORDS)]))
            out.append(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b"]))
        rows.append(("".join(out), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), ("...", "fr")] + rows[:30] + [("aa aa " * 500, "rep"), ("Word " * 200_000, "long")]


@pytest.mark.parametrize("seed,sample,lowered,bits", [(1, 8, None, 1 << 20), (2, 50, 40, 1 << 20), (3, 1, 1, 1 << 10)])
def test_equals_brute_force(spark, seed, sample, lowered, bits):
    """Whatever the sample proposes (the second one nearly nothing) and however full the table is."""
    rows = texts(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    df = df.repartition(5).withColumns({"phrase": F.lit("x"), "n": F.lit(1), "k": F.lit(1), "a": F.lit(2)})
    got = sorted(map(tuple, P.collocations(df, sample=sample, lowered=lowered, bits=bits).collect()))
    assert got == brute(rows)


def test_failures_of_the_sample_are_expanded(spark):
    rows = [("a b c d e", "en")] * 40 + [("p q", "en")] * 5
    df = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["phrase"], r["n"]) for r in P.frequent_phrases(df, sample=2, lowered=1000).collect() if r["k"] > 0}
    f, _ = counts(rows)
    assert got == {(" ".join(p), v) for (_, p), v in f.items() if v >= 30}


def test_border_is_counted_and_little_else(spark):
    """Only phrases whose first and last words are proposed are counted in the full pass."""
    words = list(P._count_block("en", b"a b x a b y a c", 1, 3, (1, 2), None, None))
    assert [k for k, _, _ in words] == [0, 1, 2, 3]
    members = P.Members(P._bits(spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, phrase string"), 1 << 16))
    got = {k: dict(zip(p.to_pylist(), n.tolist())) for k, p, n in
           P._count_block("en", b"a b x a b y a c", 1, 3, (1, 2), members, None)}
    assert got[2] == {"a b": 2} and 3 not in got


def test_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 50)
    import pyarrow as pa
    rows = texts(4, 40)[:-1]
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if x is None else x for _, x in rows]), pa.array([t for t, _ in rows])],
                                       names=["lang", "text"])
    got = Counter()
    for lang, data in P._blocks(iter([batch])):
        for k, p, n in P._count_block(lang, data, 1, 4, (), None, None):
            for x, c in zip(p.to_pylist(), n.tolist()):
                if k:
                    got[lang, tuple(x.split(" "))] += c
    assert got == counts(rows)[0]


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    r = spark.sql("select (cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) s "
                  "from values (9000000000000000000, 9000000000000000001, 9000000000000000003) t(a, l, r)").collect()
    assert r[0]["s"] == 2_000_000 * 9 * 10**18 // (18 * 10**18 + 4)


def test_order_and_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert P.collocations(df).count() == 0
    rows = [(f"{w} {v}.", "en") for w, v in (("é", "m"), ("z", "a"), ("\U0001f600", "b"), ("￮", "c")) for _ in range(30)]
    got = [r["phrase"] for r in P.collocations(spark.createDataFrame(rows, "text string, lang string"), sample=1, top=3)
           .orderBy("rank").collect()]
    assert got == ["z a", "é m", "￮ c"]  # UTF-8 order
