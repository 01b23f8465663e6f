"""WARC archives: written, read, and deduplicated by revisit records.

An archive is a folder of files that Spark writes and commits; each file is a
sequence of gzip members and unpacks to plain WARC/1.1.  A record has a member
for its header, one for its block, and one for the two line ends that close it.
The last one is the same for every record, so Spark reads the files as rows
parted by it: by many tasks a file, none held whole.  A new header is put before
a block without packing the block again.

``deduplicate``:

1. *Headers* of all records are read (blocks stay packed) and shuffled by payload
   digest, pre-aggregated, to find the response that every digest keeps.
2. *Revisits* join it: repeated payloads of at least ``least`` bytes, and revisit
   records that the archives hold already.
3. Records are written with fresh headers: responses with their block, revisits with
   their HTTP header only.  A bit table of fixed size names the records that may have
   become revisits; only these are shuffled, to join their decisions, all others are
   copied where they are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonspark.llm.bittable import BITS, Members, bit_table
from canonspark.llm.textops import encode, small_batches, written

LEAST = 1000  # payload bytes from which a repeated payload becomes a revisit
DATE = "2024-01-01T00:00:00Z"

# fixed values of the format: the packed record end, and the profile of revisits
END = bytes.fromhex("1f8b08000000000002ffe3e5e2e502004415c28b04000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_OPTIONS = {"lineSep": END.decode("latin-1"), "encoding": "ISO-8859-1"}  # the encoding is that of lineSep alone
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
HEADER_SCHEMA = ("record_id string, page_id long, record_type string, uri string, date string, digest string, "
                 "payload_bytes long, refers_to string")


def _packed(data: bytes) -> bytes:
    """A gzip member that doesn't hold the packed record end."""
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        z = zlib.compressobj(6, zlib.DEFLATED, 31, 8, strategy)
        out = z.compress(data) + z.flush()
        if END not in out:
            return out
    raise ValueError("a block cannot be packed without the record end in it")


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in fields if v is not None]
    return _packed(("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode("utf-8", "surrogatepass"))


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def _integer(v) -> int | None:
    return None if pd.isna(v) else int(v)


def _pack_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page_id, url, date, html in zip(pdf["page_id"], pdf["url"], pdf["date"], pdf["html"]):
            payload = encode(html)
            block = _http(payload) + payload
            uri = None if not isinstance(url, str) else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
            out.append(_head([
                ("WARC-Type", "response"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date),
                ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()),
                ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
                ("X-Page-ID", _integer(page_id))]) + _packed(block))
        yield pd.DataFrame({"record": out})


def _unpacked_head(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and the packed block."""
    z = zlib.decompressobj(31)
    head = z.decompress(record).decode("utf-8", "surrogatepass")
    if not z.eof or not head.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, z.unused_data


def _http_head(packed: bytes) -> bytes:
    """Head of a block's HTTP message; unpacks no more than it needs."""
    z, got = zlib.decompressobj(31), b""
    while b"\r\n\r\n" not in got and not z.eof:
        more = z.decompress(z.unconsumed_tail or packed if not got else z.unconsumed_tail, 4096)
        if not more and not z.unconsumed_tail:
            break
        got += more
    cut = got.find(b"\r\n\r\n")
    return got[: cut + 4] if cut >= 0 else b""


def _hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of a declared SHA-1 (archives name it in base 32 or in hex)."""
    if value is None or not value.lower().startswith("sha1:"):
        return None
    text = value[5:]
    if len(text) == 32:
        import base64

        return base64.b32decode(text.upper()).hex()
    return text.lower()


def _read_heads(verify: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for record in pdf["record"]:
                f, block = _unpacked_head(bytes(record))
                digest, size = _hex_digest(f.get("warc-payload-digest")), None
                if f["warc-type"] != "revisit":
                    size = int(f["content-length"]) - len(_http_head(block))
                    if verify or digest is None:
                        data = zlib.decompress(block, 31)
                        payload = data[len(_http_head(block)):]
                        real = hashlib.sha1(payload).hexdigest()
                        if len(data) != int(f["content-length"]) or digest not in (None, real):
                            raise ValueError(f"record {f['warc-record-id']} is damaged")
                        digest, size = real, len(payload)
                page = f.get("x-page-id")
                out.append((f["warc-record-id"], None if page is None else int(page), f["warc-type"],
                            f.get("warc-target-uri"), f.get("warc-date"), digest, size, f.get("warc-refers-to")))
            r = pd.DataFrame(out, columns=[c.split()[0] for c in HEADER_SCHEMA.split(", ")], dtype=object)
            yield r.assign(page_id=r["page_id"].astype("Int64"), payload_bytes=r["payload_bytes"].astype("Int64"))

    return run


def _id_hashes(ids) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in ids], np.uint64)


def _fresh(run: str, record_id: str) -> str:
    """The same new id wherever an old one is named."""
    return f"<{uuid.UUID(hashlib.md5((run + record_id).encode()).hexdigest()).urn}>"


def _told_apart(table, wanted: bool):
    """``record_id, record`` of the records that may (or can't) be in the table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members = Members(table.value)
        for pdf in batches:
            ids = np.array([_unpacked_head(bytes(r))[0]["warc-record-id"] for r in pdf["record"]], object)
            some = np.flatnonzero(members.has(_id_hashes(ids)) == wanted)
            yield pd.DataFrame({"record_id": ids[some], "record": pdf["record"].to_numpy()[some]})

    return run


def _rewritten(record: bytes, run: str, revisit_of: tuple | None = None) -> bytes:
    f, block = _unpacked_head(record)
    again = revisit_of is not None
    size = int(f["content-length"])
    digest = _hex_digest(f.get("warc-payload-digest"))
    if digest is None and f["warc-type"] == "response":
        digest = hashlib.sha1(zlib.decompress(block, 31)[len(_http_head(block)):]).hexdigest()
    more: list[tuple[str, object]] = []
    if again:
        head = _http_head(block)
        size, block = len(head), _packed(head)
        record_id, uri, date = revisit_of
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id and _fresh(run, record_id)),
                ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    return _head([
        ("WARC-Type", "revisit" if again else f["warc-type"]), ("WARC-Record-ID", _fresh(run, f["warc-record-id"])),
        ("WARC-Date", f.get("warc-date")), ("WARC-Target-URI", f.get("warc-target-uri")),
        ("WARC-Payload-Digest", digest and f"sha1:{digest}"), ("Content-Type", f.get("content-type")), *more,
        ("Content-Length", size), ("X-Page-ID", f.get("x-page-id"))]) + block


def _rewrite(run_id: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record": [
                _rewritten(bytes(r), run_id, (i, u, d) if k == "revisit" else None)
                for r, k, i, u, d in zip(pdf["record"], pdf["kind"], pdf["of_id"], pdf["of_uri"], pdf["of_date"])]})

    return run


def _copy(table, run_id: str):
    apart = _told_apart(table, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in apart(batches):
            yield pd.DataFrame({"record": [_rewritten(bytes(r), run_id) for r in pdf["record"]]})

    return run


def _write(records: DataFrame, path: str) -> None:
    records.select(F.col("record").cast("string").alias("value")).write.options(**_OPTIONS).text(path)


def write_pages(pages: DataFrame, path: str, date: Column | None = None) -> None:
    """A response record for every row of ``pages(page_id, url, html)`` into the new
    folder ``path``.  A null html is an empty payload; a null url or page_id gives no
    such field; spaces and control characters of a url are percent-encoded.  Repeated rows
    are records of their own.  Other columns take no part."""
    day = F.lit(DATE) if date is None else F.coalesce(date.cast("string"), F.lit(DATE))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", day.alias("date"))
    _write(small_batches(rows).mapInPandas(_pack_pages, "record binary"), path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The packed records ``(record)`` of an archive folder."""
    rows = spark.read.options(**_OPTIONS).text(path)
    return rows.select(F.col("value").cast("binary").alias("record")).where(F.octet_length("record") > 0)


def headers(packed: DataFrame, verify: bool = False) -> DataFrame:
    """``record_id, page_id, record_type, uri, date, digest, payload_bytes, refers_to``
    of every record; a revisit's ``payload_bytes`` are null.  With ``verify`` payloads
    are unpacked, digest and size are theirs, and a damaged record is an error."""
    return small_batches(packed).mapInPandas(_read_heads(verify), HEADER_SCHEMA)


def resolve(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """``record_id, kind, digest, original`` of every record: of the responses with one
    digest, that with the largest (page_id, record_id) stays one, the others of at least
    ``least`` bytes become revisits of it.  A revisit whose digest has no response
    keeps what it refers to."""
    place = F.struct("page_id", "record_id", "uri", "date")
    originals = (heads.where("record_type = 'response' and digest is not null").groupBy("digest")
                 .agg(F.max(place).alias("original")))
    joined = heads.join(originals, "digest", "left")
    again = (F.col("payload_bytes") >= least) & (F.col("record_id") != F.col("original.record_id"))
    kind = F.when((F.col("record_type") == "response") & again, "revisit").otherwise(F.col("record_type"))
    known = F.when(kind == "revisit", F.coalesce("original", F.struct(
        F.lit(None).cast("long").alias("page_id"), F.col("refers_to").alias("record_id"),
        F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("date"))))
    return joined.select("record_id", kind.alias("kind"), "digest", known.alias("original"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST, bits: int = BITS) -> None:
    """Read the archive folder ``source`` and write ``target`` with every record under a
    fresh header; see ``resolve`` for what becomes a revisit.  ``bits``: size of the bit
    table; it changes how many records are shuffled, not the result."""
    packed, run = records(spark, source), uuid.uuid4().hex
    decided = written(resolve(headers(packed), least).where("kind = 'revisit'").select(
        "record_id", "kind", F.col("original.record_id").alias("of_id"), F.col("original.uri").alias("of_uri"),
        F.col("original.date").alias("of_date")), "revisits")
    table = spark.sparkContext.broadcast(
        bit_table(decided.select("record_id"), lambda batch: _id_hashes(batch.column(0).to_pylist()), bits))
    copied = small_batches(packed).mapInPandas(_copy(table, run), "record binary")
    maybe = small_batches(packed).mapInPandas(_told_apart(table, True), "record_id string, record binary")
    joined = maybe.join(decided, "record_id", "left").drop("record_id")
    _write(copied.unionByName(joined.mapInPandas(_rewrite(run), "record binary")), target)


def resolved(heads: DataFrame) -> DataFrame:
    """Revisit records joined to the responses they refer to: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to`` (page_id of the response) of every record."""
    own = heads.where("record_type <> 'revisit'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    of = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("size"))
    again = heads.where("record_type = 'revisit'").join(of, "refers_to", "left").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.col("of_page").alias("refers_to"))
    return own.unionByName(again)
