import random

import pytest
from pyspark.sql import functions as F

from canonspark.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing by weight with a ceiling, spelled out."""
    names = sorted([k for k in sizes if k is not None]) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(out.values())
        share = {k: rest * w[k] / sum(w[x] for x in left) for k in left}
        above = [k for k in left if share[k] > most * sizes[k]]
        if not above:
            return {**out, **share}
        for k in above:
            out[k] = float(most * sizes[k])
            left.discard(k)
    return out


def docs(spark, seed, n=900):
    rng = random.Random(seed)
    sources = ["a", "B", "é", None, "hot", "hot", "hot", "z", "empty"]
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        rows.append((i, s, 0 if s == "empty" else rng.choice([0, 1, 5, 30, 200])))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)


@pytest.mark.parametrize("seed,group", [(1, 128), (2, 4)])
def test_targets_copies_and_reruns(spark, seed, group):
    rows, df = docs(spark, seed)
    df = df.withColumn("mix", F.lit("clash")).withColumn("p", F.lit(1)).withColumn("of", F.lit(2))
    got = M.mix(df, group=group).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, z in rows:
        sizes[s] = sizes.get(s, 0) + z
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        m = r["mix"]
        assert m["source_size"] == sizes[r["source"]]
        assert m["target"] == pytest.approx(want[r["source"]])
        assert 0 <= m["copies"] <= 3 and m["taken"] == m["copies"] * r["size"]
        taken[r["source"]] += m["taken"]
    for s, z in sizes.items():
        # off by less than one copy of the largest document
        assert abs(taken[s] - want[s]) < 200 + 1e-6, s
    again = M.mix(df.repartition(7), group=group)
    assert sorted((r["doc_id"], r["mix"]["copies"]) for r in got) == \
        sorted((r["doc_id"], r["mix"]["copies"]) for r in again.collect())


def test_copies_have_their_expectation(spark):
    """Over many sources a document's extra copy comes up as often as its fraction."""
    units = spark.range(40 * 200).selectExpr(
        "cast(id div 40 as string) as source", "id as u1", "id * 7 as u2", "0.3D as p",
        "cast(1 + id % 9 as double) as s")
    got = M.pivotal_rounding(units, 0, 8).agg(F.count("u1"), F.avg("take")).first()
    assert got[0] == 8000 and abs(got[1] - 0.3) < 0.015


def test_empty_null_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long")
    assert M.mix(none).count() == 0
    rows = [(None, "a", 4)] * 5 + [(7, "a", 4)] * 3 + [(8, None, None), (9, None, 0)] + [(10, "b", 1000)] * 2
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows)
    assert all(r["mix"]["copies"] == 3 for r in got if r["source"] == "a")
    assert all(r["mix"]["taken"] == 0 for r in got if r["source"] is None)


def test_plan_has_no_python(spark):
    _, df = docs(spark, 3, 50)
    plan = M.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_word_count(spark):
    df = spark.createDataFrame([(" a\tb\n c ",), (None,), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(M.word_count(F.col("t"))).collect()] == [3, 0, 0, 1]
