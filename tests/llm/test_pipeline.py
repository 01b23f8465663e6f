import os
import re
import sys
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from canonspark.llm import mixing
from canonspark.llm.textops import space_words

sys.path.insert(0, os.path.dirname(__file__))
import test_decontaminate  # noqa: E402
import test_mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_near_groups(rows, k=5, least=80):
    """doc_id -> smallest id reachable, every pair compared."""
    sets = {}
    for i, t in rows:
        w = space_words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    extra = [(10_000 + i, r["text"], r["lang"], r["source"], r["n_chars"])
             for i, r in enumerate(docs.where("doc_id % 9 = 0").collect())]
    extra += [(20_000, None, None, None, None), (None, "", "en", "src1", 0)]
    docs = P.written(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "t")
    seen = [docs]
    for _, f in P.STAGES:
        seen.append(P.written(f(spark, seen[-1], SF), "t"))
    return [x.collect() for x in seen]


def test_columns(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == P.COLUMNS


def test_quality_keeps_clean_and_drops_bad(spark, stages):
    left = {r["doc_id"] for r in stages[1]}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] in left for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["doc_id"] in left for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_one_of_each_near_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1] if r["doc_id"] is not None]
    want = {i for i, c in plain_near_groups(rows).items() if i == c}
    assert {r["doc_id"] for r in stages[2] if r["doc_id"] is not None} == want
    assert sum(r["doc_id"] is None for r in stages[2]) == sum(r["doc_id"] is None for r in stages[1])


def repeated_bytes(texts, window, words):
    """Bytes that lose: strings of ``window`` bytes and passages of ``words`` words, all counted."""
    data = [b"" if t is None else t.encode() for t in texts]
    strings = Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    lists = [[b[x:y] for x, y in s] for b, s in zip(data, spans)]
    passages = Counter(tuple(w[i:i + words]) for w in lists for i in range(len(w) - words + 1))
    out = []
    for b, s, w in zip(data, spans, lists):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if strings[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        for i in range(len(w) - words + 1):
            if passages[tuple(w[i:i + words])] > 1:
                x, y = s[i][0], s[i + words - 1][1]
                gone[x:y] = b"\1" * (y - x)
        out.append(gone)
    return data, out


def test_repeated_passages_leave(stages):
    """Strings of 400 bytes and passages of 51 words that start anywhere else, every one counted."""
    before = stages[2]
    data, lost = repeated_bytes([r["text"] for r in before], 400, P.PASSAGE)
    after = {r["doc_id"]: r for r in stages[3]}
    assert any(lost) and sum(any(x) for x in lost) < len(before)
    for r, b, gone in zip(before, data, lost):
        kept = bytes(c for c, x in zip(b, gone) if not x)
        if any(gone):
            # what is left of a character that was cut goes too
            text = kept.decode("utf-8", "replace").replace("\ufffd", "")
            if text:
                assert after[r["doc_id"]]["text"] == text and after[r["doc_id"]]["n_chars"] == len(text)
            else:
                assert r["doc_id"] not in after
        else:
            assert after[r["doc_id"]]["text"] == r["text"]


def test_short_passages_of_over_50_words_leave(spark):
    """Passages of 51 to 65 short words, under 400 bytes, in two documents each."""
    own = iter(range(10 ** 6))
    rows, want = [], {}
    for n in (50, 51, 52, 60, 65):
        passage = " ".join(f"p{next(own)}" for _ in range(n))
        assert len(passage) < 400
        for gap, copy in ((" ", passage), ("\n", passage.replace(" ", "  "))):
            head, tail = (" ".join(f"w{next(own)}é" for _ in range(30)) for _ in range(2))
            text = head + gap + copy + gap + tail
            want[len(rows)] = head + gap + gap + tail if n > 50 else text
            rows.append((len(rows), text, "en", "s", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in P.suffix_dedup_stage(spark, docs.repartition(3), SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in stages[3] if not test_decontaminate.brute(r["text"], items, 13)[3]}
    assert {r["doc_id"] for r in stages[4]} == want


def test_mix_meets_its_targets(stages):
    sizes, largest = {}, 0
    for r in stages[4]:
        n = len(space_words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest = max(largest, n)
    want = test_mixing.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    copies = {}
    for r in stages[5]:
        assert r["size"] == len(space_words(r["text"]))
        taken[r["source"]] += r["size"]
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= mixing.MAX_COPIES for c in copies.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) < largest + 1


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and out.agg(F.count("*")).first()[0] == 0
