import gzip
import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from canonspark.llm import warc as W
from canonspark.llm.queries import op12_warc


def brute(rows, least=1000):
    def payload(r):
        return (r[2] or "").encode()

    largest = {}
    for r in rows:
        if len(payload(r)) >= least and r[0] is not None:
            largest[payload(r)] = max(largest.get(payload(r), r[0]), r[0])
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        p = payload(r)
        again = len(p) >= least and p in seen
        seen.add(p)
        out.append((r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response",
                    largest.get(p) if again else None))
    return sorted(out, key=str)


def pages(seed=1, n=300):
    rng = random.Random(seed)
    bodies = ["<p>Äé WARC/1.1\r\n\r\n</p>" * 60, "x" * 999, "y" * 1000, "z" * 1001, None, "",
              "\r\n\r\n" * 300, "<html>" + "long " * 300_000]
    rows = [(i, rng.choice([f"http://h/{i}", None, f"http://h/a b\r\n{i}"]),
             rng.choice(bodies[:7]) if rng.random() < 0.7 else f"<b>{i}</b>" * rng.randrange(1, 400)) for i in range(n)]
    return rows + [(n, "u", bodies[7]), (n + 1, "u", bodies[7]), (7, "again", bodies[0]), (7, "again", bodies[0])]


SCHEMA = "page_id long, url string, html string"


def paths(tmp_path):
    return [f"{tmp_path}/{uuid.uuid4().hex}" for _ in range(2)]


@pytest.mark.parametrize("bits", [W.BITS, 64])
def test_equals_brute_force_and_round_trip(spark, tmp_path, bits):
    """Also with a bit table in which nearly everything may be a member."""
    rows = pages()
    a, b = paths(tmp_path)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("record", F.lit(1)).withColumn("date", F.lit("x"))
    W.write_pages(df, a)
    W.deduplicate(spark, a, b, bits=bits)
    heads = W.headers(W.records(spark, b), verify=True)
    assert sorted(map(tuple, W.resolved(heads).collect()), key=str) == brute(rows)
    ids = [r["record_id"] for r in heads.collect()]
    old = {r["record_id"] for r in W.headers(W.records(spark, a)).collect()}
    assert len(set(ids)) == len(rows) and not old & set(ids)  # fresh headers
    # deduplicating what is deduplicated changes nothing, and its revisits stay resolved
    c = f"{tmp_path}/{uuid.uuid4().hex}"
    W.deduplicate(spark, b, c)
    assert sorted(map(tuple, W.resolved(W.headers(W.records(spark, c), verify=True)).collect()), key=str) == brute(rows)


def plain_records(data: bytes):
    """A reader of its own: header, then Content-Length bytes, then two line ends."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4:]


def test_files_unpack_to_plain_warc(spark, tmp_path):
    rows = pages(2, 60)
    a, b = paths(tmp_path)
    W.write_pages(spark.createDataFrame(rows, SCHEMA).repartition(2), a)
    W.deduplicate(spark, a, b)
    for folder in (a, b):
        got = [x for f in (tmp_path / folder).glob("part-*") for x in plain_records(gzip.decompress(f.read_bytes()))]
        assert len(got) == len(rows)
        kept = {f[b"WARC-Record-ID"]: f for f, _ in got if f[b"WARC-Type"] == b"response"}
        for f, block in got:
            head, _, payload = block.partition(b"\r\n\r\n")
            assert head.startswith(b"HTTP/1.1 200 OK")
            if f[b"WARC-Type"] == b"response":
                assert f[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(payload).hexdigest().encode()
            else:
                assert payload == b"" and f[b"WARC-Profile"].decode() == W.PROFILE
                assert kept[f[b"WARC-Refers-To"]][b"WARC-Payload-Digest"] == f[b"WARC-Payload-Digest"]
    texts = {(r[2] or "").encode() for r in rows}
    assert {x.partition(b"\r\n\r\n")[2] for _, x in got} <= texts | {b""}


def test_many_tasks_read_a_file(spark, tmp_path):
    a, _ = paths(tmp_path)
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choices("abcdef <>é", k=3000))) for i in range(2000)]
    W.write_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1), a)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        packed = W.records(spark, a)
        assert packed.rdd.getNumPartitions() > 8
        heads = W.headers(packed, verify=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["page_id"] for r in heads) == list(range(2000))


def test_a_block_that_holds_the_record_end(spark, tmp_path):
    block = b"".join(random.Random(4).randbytes(50) + W.END for _ in range(40))
    packed = W._packed(block)
    assert W.END not in packed and gzip.decompress(packed) == block
    assert gzip.decompress(W.END) == b"\r\n\r\n"


def test_damaged_record_is_an_error(spark, tmp_path):
    head = W._head([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("Content-Length", 5),
                    ("WARC-Payload-Digest", "sha1:" + "0" * 40)])
    df = spark.createDataFrame([(bytearray(head + W._packed(b"abcde")),)], "record binary")
    with pytest.raises(Exception, match="damaged"):
        W.headers(df, verify=True).collect()


def test_base32_digests_revisits_without_response_and_null_id(spark):
    heads = spark.createDataFrame(
        [("<a>", None, "response", "u", "d", "aa", 2000, None), ("<b>", 1, "response", "u", "d", "aa", 2000, None),
         ("<c>", 2, "revisit", "u", "d", "aa", None, "<old>"), ("<d>", 3, "revisit", "u", "d", "bb", None, "<gone>"),
         ("<e>", 4, "metadata", None, None, None, 3, None)], W.HEADER_SCHEMA)
    got = {r["record_id"]: (r["kind"], r["original"] and r["original"]["record_id"]) for r in W.resolve(heads).collect()}
    assert got == {"<a>": ("revisit", "<b>"), "<b>": ("response", None), "<c>": ("revisit", "<b>"),
                   "<d>": ("revisit", "<gone>"), "<e>": ("metadata", None)}
    import base64
    d = hashlib.sha1(b"x")
    assert W._hex_digest("sha1:" + base64.b32encode(d.digest()).decode()) == d.hexdigest()


def test_empty_table_and_query(spark, tmp_path):
    a, b = paths(tmp_path)
    W.write_pages(spark.createDataFrame([], SCHEMA), a)
    W.deduplicate(spark, a, b)
    assert W.resolved(W.headers(W.records(spark, b))).count() == 0
    rows = pages(5, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    r = op12_warc(spark, str(tmp_path))
    assert r.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, r.collect()), key=str) == brute(rows)
