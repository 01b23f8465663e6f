"""Entity match (brute force), k-means properties, TF-IDF, history, CSV, stream."""

import itertools
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonspark.functions import similarity as S
from canonspark.operators import entity as EN
from canonspark.operators import kmeans as KM
from canonspark.operators import reshape as R
from canonspark.plans import cleaning as CL
from canonspark.sources import csv as CSV
from canonspark.sources import history as H
from canonspark.streaming import apply_stream as ST


def _search(queries, ents, most=5):
    """Every entity scored."""
    def keys(t):
        return {t[i:i + 2] for i in range(len(t) - 1)} or {t}

    ents = [(n, o) for n, o in ents if n]
    df = {}
    for n, _ in ents:
        for k in keys(n.lower()):
            df[k] = df.get(k, 0) + 1
    out = {}
    for q in queries:
        hits = [(-sum(math.floor(1000 * (1 + math.log(len(ents) / df[k]))) for k in keys(q.lower()) & keys(n.lower())), o, n)
                for n, o in ents]
        out[q] = sorted(h for h in hits if h[0])[:most]
    return out


def test_entity_match_brute_force(spark):
    queries = ["nation_1", "the nation_5", "NATION 12", "zzz", "ation", "nat"]
    ents = [(f"NATION_{i}", i) for i in range(25)] + [("", 99), ("Atlantis", 30)]
    qdf = spark.createDataFrame([(q,) for q in queries], "query string")
    edf = spark.createDataFrame(ents, "name string, ent_ord int")
    got = {r.query: (r.canonical, r.score) for r in EN.canonical_names(qdf, edf).collect()}
    want = {}
    for q, found in _search(queries, ents).items():
        if found:
            best = max(range(len(found)), key=lambda i: (S.partial_ratio(q.lower(), found[i][2].lower()), -i))
            want[q] = (found[best][2], S.partial_ratio(q.lower(), found[best][2].lower()))
    assert got == want and "zzz" not in got


@pytest.mark.parametrize("most", [1, 5])
def test_search_equals_scoring_every_entity(spark, most):
    """Skewed keys, ties, repeated names; and most postings of the common keys are not read."""
    import random
    rng = random.Random(8)
    parts = ["in", "inin", "ion", "al", "x", "q7", "zz", "intern", "ab", "nord"]
    ents = [("inc " + "".join(rng.choices(parts, k=rng.randrange(1, 6))), rng.randrange(50)) for _ in range(400)]
    ents += [("a", 1), ("in", 2), ("In", 2)]
    queries = sorted({"inc " + "".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(60)} | {"a", "in", "b"})
    qdf = spark.createDataFrame([(q, q.lower()) for q in queries], "query string, ql string")
    edf = spark.createDataFrame([(*x, x[0].lower()) for x in ents], "name string, ent_ord int, el string")
    got = {}
    for r in EN.search(qdf, edf, most).collect():
        got.setdefault(r.query, []).append((r.place, -r.relevance, r.ent_ord, r["name"]))
    want = {q: [(i + 1, *x) for i, x in enumerate(found)] for q, found in _search(queries, ents, most).items() if found}
    assert {q: sorted(x) for q, x in got.items()} == want


def test_a_lone_candidate_wins_at_any_score(spark):
    q = spark.createDataFrame([("united states",)], "query string")
    e = spark.createDataFrame([("USA Corporation", 1)], "name string, ent_ord int")
    r = EN.canonical_names(q, e).collect()
    assert [x.canonical for x in r] == ["USA Corporation"] and r[0].score < 75


def test_tfidf_rows_are_unit_length(spark):
    nodes = spark.createDataFrame([("g", "abc", 2), ("g", "abd", 1), ("g", "x", 1)],
                                  "group_key string, norm string, n long")
    t = KM.tfidf(nodes).collect()
    norms = {}
    for r in t:
        norms[r.norm] = norms.get(r.norm, 0.0) + r.weight ** 2
    assert set(norms) == {"abc", "abd"}          # 'x' has no 2-gram
    assert all(abs(v - 1.0) < 1e-9 for v in norms.values())
    ab = [r for r in t if r.gram == "ab"][0]
    assert ab.df == 3 and abs(ab.idf - (math.log(5 / 4) + 1)) < 1e-12


def test_kmeans_properties(spark):
    rows = [(i, v) for i, v in enumerate(["red gear", "red gears", "red gear", "blue bolt", "blue bolts",
                                          "blue bolt", "hot rod", "hot rods"])]
    raw = spark.createDataFrame(rows, "row_id long, name string")
    g = CL.group_in_column(raw, ["name"], ml=True)
    c = g.clustered.collect()
    assert {r.norm for r in c} == {"red gear", "red gears", "blue bolt", "blue bolts", "hot rod", "hot rods"}
    ids = {r.cluster_id for r in c}
    assert 1 <= len(ids) <= 8 and ids == set(range(1, len(ids) + 1))
    # repeatable with the fixed seed
    again = {r.norm: r.cluster_id for r in CL.group_in_column(raw, ["name"], ml=True).clustered.collect()}
    assert again == {r.norm: r.cluster_id for r in c}


def _vectors(entries):
    rows = entries.collect()
    grams = {g: i for i, g in enumerate(sorted({r.gram for r in rows}))}
    out = {}
    for r in rows:
        out.setdefault(r.norm, np.zeros(len(grams)))[grams[r.gram]] = r.weight
    return out, len(grams)


def _km_nodes(spark, values):
    return spark.createDataFrame([("g", v, (0, i), i % 4 + 1) for i, v in enumerate(values)],
                                 "group_key string, norm string, occ struct<col_ord:int,row_id:bigint>, n bigint")


def _silhouette(vec, labels, n):
    """Euclidean, every occurrence a point."""
    names = [v for v in labels for _ in range(n[v])]
    x = np.array([vec[v] for v in names])
    c = np.array([labels[v] for v in names])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, c == o].mean() for o in set(c) - {c[i]})
        out.append(0.0 if max(a, b) <= 0 else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("block", [2, 256])
def test_silhouettes_equal_the_definition(spark, monkeypatch, block):
    """Given labels, a value without n-grams, values in one block and in several."""
    monkeypatch.setattr(KM, "BLOCK", block)
    vals = ["red gear", "red gears", "blue bolt", "blue bolts", "hot rod", "hot rods", "x", "gear red", "rod"]
    nodes = _km_nodes(spark, vals)
    entries = KM.tfidf(nodes).select("group_key", "norm", "gram", "weight")
    labels = {2: [0, 0, 1, 1, 1, 1, 0, 0, 1], 3: [0, 0, 1, 1, 2, 2, 3, 0, 2], 4: [1] * 9}
    assigned = spark.createDataFrame([("g", k, v, c) for k, cs in labels.items() for v, c in zip(vals, cs)],
                                     "group_key string, k int, norm string, c int")
    got = {r.k: r.score for r in KM.silhouettes(assigned, entries, nodes.select("group_key", "norm", "n")).collect()}
    vec, size = _vectors(entries)
    vec["x"] = np.zeros(size)
    n = {v: i % 4 + 1 for i, v in enumerate(vals)}
    assert set(got) == {2, 3}
    for k, score in got.items():
        assert abs(score - _silhouette(vec, dict(zip(vals, labels[k])), n)) < 1e-7


@pytest.mark.parametrize("block", [7, 256])
def test_kmeans_runs_end_at_a_fixed_point(spark, monkeypatch, block):
    """Values in one block and in several.  Every value at its nearest mean, the means those of the members, no start worse
    than the random one among those chosen, and the k with the best silhouette."""
    monkeypatch.setattr(KM, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = ["red gear", "blue bolt", "hot rod", "small anvil", "large widget"]
    vals = sorted({b[:k] + c + b[k:] for b in base for k in rng.integers(0, len(b), 4) for c in ("x", "s")})
    nodes = _km_nodes(spark, vals)
    n = {v: i % 4 + 1 for i, v in enumerate(vals)}
    labelled, inertia, entries = KM.kmeans_runs(nodes, "direct")
    vec, size = _vectors(entries)
    x = np.array([vec[v] for v in vals])
    w = np.array([n[v] for v in vals], float)
    runs = {}
    for r in KM.labels_of(labelled).collect():
        runs.setdefault((r.k, r.s), {})[r.norm] = r.c
    assert set(runs) == {(k, s) for k in range(2, 9) for s in (0, 1)}
    sums = {}
    for key, labels in runs.items():
        assert set(labels) == set(vals)
        c = np.array([labels[v] for v in vals])
        means = {o: np.average(x[c == o], axis=0, weights=w[c == o]) for o in set(c)}
        d = {o: ((x - m) ** 2).sum(axis=1) for o, m in means.items()}
        own = np.array([d[o][i] for i, o in enumerate(c)])
        assert (own <= np.min(list(d.values()), axis=0) + 1e-7).all(), key
        sums[key] = float((own * w).sum())
    got = {(r.k, r.s): r.inertia for r in inertia.collect()}
    assert all(abs(got[key] - v) < 1e-6 for key, v in sums.items())
    best = {k: min((round(sums[k, s], 9), s) for s in (0, 1)) for k in range(2, 9)}
    score = {k: _silhouette(vec, runs[k, s], n) for k, (_, s) in best.items() if len(set(runs[k, s].values())) > 1}
    k = max(score, key=lambda k: (round(score[k], 9), -k))
    out = {r.norm: r.cluster_id for r in KM.kmeans_clusters(nodes, "direct").collect()}
    want = runs[k, best[k][1]]
    assert len({(out[v], want[v]) for v in vals}) == len(set(out.values())) == len(set(want.values()))


def test_kmeans_one_cluster_without_ngrams(spark):
    raw = spark.createDataFrame([(i, v) for i, v in enumerate("abc")], "row_id long, name string")
    g = CL.group_in_column(raw, ["name"], ml=True)
    assert {r.cluster_id for r in g.clustered.collect()} == {1}


def test_history_round_trip(spark):
    raw = spark.createDataFrame([(0, "acme"), (1, "acme"), (2, "zed")], "row_id long, name string")
    a = CL.apply_cleaning(CL.group_in_column(raw, ["name"]))
    base = tempfile.mkdtemp(prefix="canon-hist-")
    cid = H.save_run(base, 7, "f.csv", "direct", a.overall, a.summary)
    H.save_run(base, 8, "g.csv", "direct", a.overall, a.summary)
    rows = H.history(spark, base, 7).collect()
    assert {r.clean_id for r in rows} == {cid} and rows[0].column == "name"
    assert [r.column for r in H.run_details(spark, base, cid).collect()] == ["name"]
    import pytest
    with pytest.raises(ValueError):
        H.save_run(base, 7, "", "direct", a.overall, a.summary)


def test_a_save_that_stops_half_way_is_not_seen(spark, monkeypatch):
    raw = spark.createDataFrame([(0, "acme", "b"), (1, "acme", "c"), (2, "zed", "d")], "row_id long, name string, other string")
    a = CL.apply_cleaning(CL.group_in_column(raw, ["name", "other"]))
    base = tempfile.mkdtemp(prefix="canon-hist-")
    first = H.save_run(base, 7, "f.csv", "direct", a.overall, a.summary)

    def killed(*args, **kw):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(H, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            H.save_run(base, 7, "g.csv", "direct", a.overall, a.summary)
    assert {r.clean_id for r in H.history(spark, base).collect()} == {first}
    # the retry is the run; saving a run again adds nothing and keeps its date
    second = H.save_run(base, 7, "g.csv", "direct", a.overall, a.summary)
    before = sorted(map(tuple, H.history(spark, base).collect()))
    assert H.save_run(base, 7, "g.csv", "direct", a.overall, a.summary) == second
    assert sorted(map(tuple, H.history(spark, base).collect())) == before
    assert H.save_run(base, 7, "g.csv", "direct", a.overall, a.summary, run_key="2") != second
    nested = {r.clean_id: r for r in H.nested_history(spark, base, 7, most=1).collect()}
    assert len(nested) == 3 and nested[first].n_summaries == 2
    assert [x["column"] for x in nested[first].summaries] == ["name"]
    assert [x["column"] for x in H.nested_history(spark, base).first().summaries] == ["name", "other"]


def test_csv_na_tokens_and_blank_headers(spark):
    d = tempfile.mkdtemp(prefix="canon-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write('name,,score\n"Acme, Inc",NA,1\nnull,x,N/A\n" NA",None,\n')
    df = CSV.read_csv(spark, p)
    rows = df.collect()
    assert rows[0][0] == "Acme, Inc" and rows[0][1] is None
    assert rows[1][0] is None and rows[1][2] is None
    assert rows[2][0] == " NA" and rows[2][1] is None and rows[2][2] is None
    assert [CSV.display_name(c) for c in df.columns] == ["name", "", "score"]


def test_csv_headers(spark):
    assert CSV.header_names(["a", None, "a", "", "_c3", "a.1", "a"]) == [
        "a", "Unnamed: 1", "a.1", "Unnamed: 3", "_c3", "a.1.1", "a.2"]
    d = tempfile.mkdtemp(prefix="canon-csv-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write('a.b,_c1,Unnamed: 2\n1,NA,x\n"two\nlines",2,\n')
    df = CSV.read_csv(spark, d)
    assert [tuple(r) for r in df.collect()] == [("1", None, "x"), ("two\nlines", "2", None)]
    assert [CSV.display_name(c) for c in df.columns] == ["a.b", "_c1", ""]


@pytest.mark.parametrize("split", ["40b", "97b", "1k", "128m"])
def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, split):
    """Against a sequential reader, whatever the size of a split is; splits begin and end
    inside quoted fields, and some lie inside one."""
    import csv
    import random
    rng = random.Random(6)
    pieces = ["x", "a,b", 'say ""', "one\ntwo", "\n\n", "é, \n ö", "5 inch", "", " ", "line\n" * 12, 'he said "no"\n']
    rows = [[str(i), rng.choice(pieces) + rng.choice(pieces), rng.choice(pieces)] for i in range(80)]
    for k, part in enumerate((rows[:50], rows[50:])):
        with open(tmp_path / f"p{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "two\nlines", "c"])
            w.writerows(part)
            f.write('\n999,5" pipe,"q"\n' if k else "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = CSV.read_csv(spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert df.columns == ["id", "two\nlines", "c"] and (tasks > 4 or split in ("1k", "128m"))
    want = [tuple(None if x in CSV.NA_TOKENS else x for x in r) for r in rows] + [("999", '5" pipe', "q")]
    assert got == want


def test_csv_line_states():
    """Both hypotheses on single lines, against a character by character reading."""
    import random

    def walk(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "field"
            elif state == "field":
                state = "start" if c == "," else "field"
            elif state == "quoted":
                state = "closing" if c == '"' else "quoted"
            else:
                state = "quoted" if c == '"' else "start" if c == "," else "field"
        return state == "quoted"

    rng = random.Random(7)
    for _ in range(4000):
        line = "".join(rng.choices('",a b', k=rng.randrange(12)))
        for inside in (False, True):
            assert CSV._ends_inside(line, inside) == walk(line, inside), (line, inside)


def test_both_record_shapes(spark):
    d = tempfile.mkdtemp(prefix="canon-json-")
    with open(os.path.join(d, "rows.json"), "w") as f:
        f.write('{"a.b": "x", "n": 1}\n{"n": 2}\n')
    with open(os.path.join(d, "lists.json"), "w") as f:
        f.write('{"a.b": ["x", null], "n": [1, 2]}\n{"a.b": ["z"], "n": []}\n')
    schema = T.StructType([T.StructField("a.b", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in CSV.read_records(spark, os.path.join(d, "rows.json"), schema).collect()] == [("x", 1), (None, 2)]
    got = CSV.read_column_lists(spark, os.path.join(d, "lists.json"), schema).collect()
    assert [tuple(r) for r in got] == [("x", 1), (None, 2), ("z", None)]


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="canon-stream-")
    src = os.path.join(d, "src")
    raw = spark.createDataFrame([(0, "Acme"), (1, "acme!"), (2, "Zed")], "row_id long, name string")
    raw.write.parquet(src)
    vmap = CL.group_in_column(raw, ["name"]).value_map()
    stream = spark.readStream.schema(raw.schema).parquet(src)
    ST.run_to_parquet(stream, vmap, "name", os.path.join(d, "out"), os.path.join(d, "ck"))
    got = {(r.row_id, r.name_cleaned) for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    want = {(r.row_id, r.name_cleaned) for r in ST.clean_column(raw, vmap, "name").collect()}
    assert got == want == {(0, "acme"), (1, "acme"), (2, "zed")}


def test_learning_stream_equals_batch_and_a_batch_may_run_again(spark, tmp_path):
    import random
    from canonspark.streaming import learn_stream as LS
    rng = random.Random(5)
    base = ["small ring", "red gear", "blue bolt", "hot rod", "anvil"]
    vals = [(lambda b, k: b[:k] + rng.choice("xyz") + b[k:])(rng.choice(base), rng.randrange(5)) for _ in range(60)]
    rows = [(i, v) for i, v in enumerate([*vals, None, " ", "!!", "Small Ring", "small ring!"])]
    raw = spark.createDataFrame(rows, "row_id long, name string")
    state = f"{tmp_path}/state"
    parts = [raw.where("row_id < 20"), raw.where("row_id between 20 and 45"), raw.where("row_id > 45")]
    for i in (0, 1, 1, 2):                       # batch 1 runs again
        LS.learn_batch(parts[i], i, "name", "row_id", state)
    got = {r.norm: r.cluster_id for r in LS.clusters(spark, state).collect()}
    want = CL._cluster("direct", ["name"], raw, R.melt(raw, ["name"]), None, "ratio", 75, "leader", None, False)
    assert got == {r.norm: r.cluster_id for r in want.clustered.collect()}
