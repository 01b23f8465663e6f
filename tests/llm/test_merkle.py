import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from canonspark.llm import merkle as M
from canonspark.llm.queries import op13_merkle
from canonspark.llm.textops import ascii_lower


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(nodes, at):
    """Root over ``nodes`` and the siblings of place ``at``, bottom up."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8: at // 8 * 8 + 8]
        siblings.append((at % 8, run[:at % 8] + run[at % 8 + 1:]))
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], siblings


def brute(rows):
    def leaf(r, text):
        return H(*map(field, (r[0], r[1], r[2], r[3], text)))

    trees = {}
    for r in rows:
        trees.setdefault("0" if r[2] is None else "1" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(trees, key=lambda s: s.encode())
    for t in names:
        trees[t].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in trees[t]], 0)[0] for t in names]
    out = []
    for i, t in enumerate(names):
        for at, (_, _, h, r) in enumerate(trees[t]):
            sub, sib = climb([x[2] for x in trees[t]], at)
            root, more = climb(subroots, i)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r, lower(r[4]) if changed else r[4])
            for place, others in sib + more:
                fold = H(*others[:place], fold, *others[place:])
            out.append((r[0], h, sub, root, H(*[x for _, o in sib + more for x in o]), fold, fold == root))
    return sorted(out, key=str)


def rows_of(n):
    langs = ["en"] * 12 + ["de", "é", None, "", "zz"]
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", langs[i % 17], None if i % 5 == 0 else i,
             None if i % 11 == 0 else "" if i % 13 == 0 else f"Text Ä {i}" * (i % 4)) for i in range(n)]
    rows += [(n + i, "s", f"lone{i:03d}", 1, "One leaf") for i in range(70 if n > 100 else 0)]
    return rows + [(5, "s0", "en", 3, "again"), (5, "s0", "en", 3, "again"), (None, "s", "en", 1, "No Id")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def spark_rows(df):
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    text = F.when(changed, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    claim = M.row_hash([text if f == "text" else F.col(f) for f in M.FIELDS])
    return sorted(map(tuple, M.verify(M.build(df, claim=claim)).collect()), key=str)


@pytest.mark.parametrize("n", [0, 700])
def test_equals_brute_force(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({"tree": F.lit("x"), "pos": F.lit(1), "members": F.lit(1), "leaf": F.lit(2)})
    assert spark_rows(df) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_heights(spark, n):
    rows = [(i, "s", "en", 1, f"Row {i}") for i in range(n)]
    assert spark_rows(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    m = M.build(spark.createDataFrame([], SCHEMA))
    assert m.root is None and M.verify(m).count() == 0


def test_very_long_text_and_query_columns(spark, tmp_path):
    rows = [(1, "s", "en", 1, "Word " * 400_000), (2, "s", "en", 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert spark_rows(df) == brute(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    r = op13_merkle(spark, str(tmp_path))
    assert r.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, r.collect()), key=str) == brute(rows)


def test_nodes_name_their_parents(spark):
    m = M.build(spark.createDataFrame(rows_of(200), SCHEMA))
    nodes = {(r["tree"], r["level"], r["pos"]): r for r in m.nodes.collect()}
    for k, r in nodes.items():
        if r["link"] is not None:
            parent = nodes[(r["link"]["tree"], r["link"]["level"], r["link"]["pos"])]
            assert parent["children"][r["link"]["at"]] == r["hash"]
    assert [bytes(r["hash"]).hex() for r in nodes.values() if r["link"] is None] == [m.root]
