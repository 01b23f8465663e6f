import random

from canonspark.llm import licenses as L
from canonspark.llm.textops import alnum_words


def brute(text):
    w = [x.decode() for x in alnum_words(text)]

    def places(t):
        k = len(t.key)
        return [i for i in range(len(w) - k + 1) if tuple(w[i:i + k]) == t.key]

    base = [(t.label, i) for t in L.PHRASES for i in places(t)]
    found = []
    for t in L.TEMPLATES:
        for i in places(t):
            s = i - t.key_at
            share = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t.words)) / len(t.words)
            if share >= L.LEAST:
                found.append((t.label, share))
    starts = [i for _, i in base]
    names = {x for x, _ in base}
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
            ",".join(sorted(names | {x for x, _ in found})), 1.0 if base else max((s for _, s in found), default=0.0))


def texts():
    rng = random.Random(4)
    vocab = ["the", "mit", "license", "under", "cc", "by", "nc", "apache", "version", "2", "é", "x"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for t in L.TEMPLATES:
        body = list(t.words)
        out.append("foo " + ", ".join(body) + ". bar")
        out.append(" ".join(body[1:]).upper())
        out.append(" ".join([*body[:-1], "zzz", body[-1]]))
    return out + [None, "", "!!", "mit license", "cc by-nc " * 3, "The MIT License", "\x7fUNDER the\x00MIT License."]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as licenses", "3 as label")
    got = {r["doc_id"]: tuple(r)[1:] for r in L.digest(L.scan(df)).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t


def test_every_notice_is_found_by_its_own_text(spark):
    rows = [(i, f"/* Copyright 2020 */ {text} -- end") for i, (_, text, _) in enumerate(L.NOTICES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in L.digest(L.scan(df)).collect()}
    assert len(rows) > 36 and all(L.NOTICES[i][0] in labels for i, labels in got.items())


def test_templates_from_a_table_and_the_plan_does_not_grow(spark):
    """Two hundred templates; what is found equals the brute force, the plan has the nodes of a small one."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    made: tuple = ()
    for i in range(200):
        words = tuple(rng.choices(vocab, k=rng.randrange(3, 40)))
        a = rng.randrange(len(words) - 2)
        t = L.Template(f"t{i}", words, words[a:a + 3])
        made += (t,)
    docs = []
    for i in range(120):
        t = rng.choice(made)
        docs.append((i, " ".join(rng.choices(vocab, k=20) + list(t.words) + rng.choices(vocab, k=20))))
    docs.append((120, "w1 w2 " * 50_000))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"]["found"] for r in
           L.scan(df, L.template_table(spark, made, ())).collect()}
    for i, text in docs[:-1]:
        w, want = text.split(), set()
        for t in made:
            for p in range(len(w) - 2):
                if tuple(w[p:p + 3]) == t.key:
                    s = p - t.key_at
                    share = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t.words)) / len(t.words)
                    if share >= L.LEAST:
                        want.add((t.label, s, share))
        assert {(r["label"], r["start"], r["share"]) for r in got[i]} == want

    def nodes(n):
        plan = L.scan(df, L.template_table(spark, made[:n], ()))._jdf.queryExecution().optimizedPlan()
        return plan.treeString().count("\n")

    assert nodes(200) == nodes(5)


def test_empty_table_null_and_repeated_ids(spark):
    assert L.digest(L.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    df = spark.createDataFrame([(None, "under the mit license"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r["n_base"] for r in L.digest(L.scan(df)).collect()) == [0, 0, 1]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.digest(L.scan(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
