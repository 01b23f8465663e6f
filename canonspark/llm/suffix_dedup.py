"""Repeated passages: bytes covered by a string of ``window`` bytes that also
starts anywhere else, found by range-partitioned suffix sorting.

1. *Sieve.*  Every text gives its anchors (see ``anchors``): the only suffixes
   that have to be compared.  Anchors whose leading ``gram`` bytes occur once
   are dropped; an anchor is kept as a key of its leading bytes and a hash of
   everything its windows cover, so identical copies collapse to a count and
   are repeated without further work.  No bytes are shuffled here.
2. *Suffixes.*  One representative of each remaining distinct context is
   cut from its text: the suffix at the anchor and the bytes before it.
   Splitters sampled from the keys range-partition them by leading bytes.
3. *Buckets* sort their suffixes by multikey quicksort and read repeated
   windows off the common prefixes of neighbours.
4. *Boundaries.*  A gram whose suffixes lie on both sides of a splitter (it
   has more suffixes than a bucket takes) is compared across buckets: its
   windows are aggregated by hash, pre-aggregated before the shuffle.
5. The repeated stretches of a text are joined back to it and removed.

Passages of ``words`` words, however short in bytes, are found the same way in
texts where every word is a code of ``CODE`` bytes; only windows that start at a
word count there.

The sieve and the identical contexts rest on 128 bits of hash; the sorted
suffixes are compared byte by byte, the bytes before them by 64-bit hash.
"""

from __future__ import annotations

import base64
import re
import struct
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.llm.anchors import window_anchors
from canonspark.llm.suffixes import repeated_offsets
from canonspark.llm.textops import encode, small_batches, written

WINDOW, GRAM = 400, 32
BUCKET_ROWS = 20_000  # suffixes a bucket is meant to hold (about 12 MB)
SHARD_ROWS = 20_000   # anchors of a shard of texts, in which equal contexts are looked up together
SAMPLES = 32          # sampled keys for each splitter
CODE, CODE_GRAM = 8, 96  # bytes of a word's code (48 bits of hash); gram in texts of codes
CODES = 200_000       # words whose code a task remembers

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

KEY = ["k1", "k2"]
ANCHOR_SCHEMA = "k1 long, k2 long, at int, lo int, hi int, gram long, ctx long"
SUFFIX_SCHEMA = "bucket int, split boolean, gram long, ctx long, k1 long, k2 long, single boolean, " \
                "at int, lo int, hi int, before binary, suffix binary"
SPAN_SCHEMA = "k1 long, k2 long, lo int, hi int, wh binary"


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["text"]):
                b = encode(text)
                at, lo, hi, h = window_anchors(np.frombuffer(b, np.uint8), window, gram)
                if len(at) == 0:
                    continue
                # leading three bytes, then 40 bits of the gram's hash: ordered by leading bytes
                lead = np.fromiter((int.from_bytes(b[p : p + 3], "big") for p in at.tolist()), np.int64, len(at))
                g = (lead << 40) | (h & ((1 << 40) - 1))
                ctx = np.fromiter(
                    (xxhash.xxh3_64_intdigest(struct.pack("<ii", p - x, y - x) + b[x : y + window])
                     for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())), np.uint64, len(at))
                for c, v in zip(cols, (np.full(len(at), k1), np.full(len(at), k2), at, lo, hi, g,
                                       ctx.view(np.int64))):
                    c.append(v)
            if cols[0]:
                yield pd.DataFrame(dict(zip(("k1", "k2", "at", "lo", "hi", "gram", "ctx"),
                                            map(np.concatenate, cols))))

    return run


def _cut(window: int, splitters: list[tuple[int, int]]):
    """Cut the wanted contexts from a text and give each its bucket.  A gram on
    both sides of a splitter is marked as split."""
    grams = [g for g, _ in splitters]
    inner = {g for g, c in splitters if c != _WHOLE}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k1, k2, text, wanted in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["wanted"]):
                b = encode(text)
                for w in wanted:
                    g, c, at, lo, hi = w["gram"], w["ctx"], w["at"], w["lo"], w["hi"]
                    bucket = bisect_right(splitters, (g, c)) if g in inner else bisect_right(grams, g)
                    out.append((bucket, g in inner, g, c, k1, k2, w["single"], at, lo, hi,
                                b[lo:at], b[at : hi + window]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SUFFIX_SCHEMA.split(", ")])

    return run


_WHOLE = -(1 << 63)  # a splitter that stands before all contexts of its gram


def _splitters(candidates: DataFrame, rows: int, bucket_rows: int) -> list[tuple[int, int]]:
    """Keys that part the candidates into buckets of about ``bucket_rows``.
    Sampled by hash; the driver holds SAMPLES keys of 16 bytes a bucket.  A gram
    is parted only if consecutive splitters fall into it."""
    buckets = -(-rows // bucket_rows)
    if buckets < 2:
        return []
    step = max(1, rows // (buckets * SAMPLES))
    got = sorted((r[0], r[1]) for r in candidates.where(
        F.pmod(F.xxhash64("ctx", "gram"), F.lit(step)) == 0).select("gram", "ctx").collect())
    cuts = [got[len(got) * i // buckets] for i in range(1, buckets)] if got else []
    times = Counter(g for g, _ in cuts)
    return sorted({(g, c) if times[g] > 1 else (g, _WHOLE) for g, c in cuts})


def _sort_buckets(window: int, block: int = 4096):
    """Rows arrive sorted by (bucket, gram); whole grams are gathered into
    blocks of about ``block`` suffixes and sorted together."""
    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        at, lo, hi = (pdf[c].to_numpy() for c in ("at", "lo", "hi"))
        single = pdf["single"].to_numpy(dtype=bool)
        k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
        runs = repeated_offsets(list(pdf["before"]), list(pdf["suffix"]), at - hi, at - lo, window)
        # a context with several copies is repeated as a whole already
        keep = [(k1[r], k2[r], at[r] - last, at[r] - first + window, None) for r, first, last in runs if single[r]]
        return pd.DataFrame(keep, columns=["k1", "k2", "lo", "hi", "wh"])

    def across(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, r in pdf.iterrows():
            whole, n = bytes(r["before"]) + bytes(r["suffix"]), r["hi"] - r["lo"] + 1
            yield pd.DataFrame({
                "k1": r["k1"], "k2": r["k2"], "lo": r["lo"] + np.arange(n), "hi": r["lo"] + np.arange(n) + window,
                "wh": [xxhash.xxh3_128_digest(whole[i : i + window]) for i in range(n)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            split = pdf["split"].to_numpy(dtype=bool)
            if split.any():
                yield from across(pdf[split])
            held.append(pdf[~split])
            if sum(map(len, held)) < block:
                continue
            rows = pd.concat(held, ignore_index=True)
            if len(rows) == 0:
                held = []
                continue
            g = rows["gram"].to_numpy()
            end = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            # the last gram may go on in the next batch
            done, held = rows.iloc[:end], [rows.iloc[end:]]
            if len(done):
                yield local(done.reset_index(drop=True))
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows):
            yield local(rows)

    return run


def repeated_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Byte spans ``(k1, k2, spans array<struct<lo, hi>>)`` of the rows of
    ``documents(k1, k2, text)``, where (k1, k2) tells texts apart; spans of a row
    may overlap.  Rows without a repeated string are not in the result."""
    anchors = small_batches(documents).mapInPandas(_anchors(window, gram), ANCHOR_SCHEMA)
    # written, so that both sides of the join are plain shuffles and a hot gram can be split
    often = written(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "grams")
    found = written(anchors.join(often, "gram"), "anchors")
    # texts are dealt to shards of bounded size; a context that many of a shard's texts hold is
    # looked up once for all of them
    shards = max(1, -(-found.count() // SHARD_ROWS))
    place = F.struct("k1", "k2", "at", "lo", "hi")
    local = written(found.groupBy(F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).alias("shard"), "gram", "ctx")
                    .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"),
                         F.collect_list(F.struct("k1", "k2", "lo", "hi")).alias("places")), "local")
    contexts = local.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), F.min("p").alias("p"))
    contexts = written(contexts, "contexts")
    copies = contexts.where("n > 1").select("gram", "ctx")  # written: a hot context can be split
    whole = (local.select("shard", "gram", "ctx", "places").join(copies, ["gram", "ctx"]).select("shard", "places")
             .repartition("shard").select(F.explode("places").alias("x"))
             .select("x.k1", "x.k2", "x.lo", (F.col("x.hi") + window).alias("hi")))

    several = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "several")
    candidates = written(contexts.join(several, "gram").select(
        "gram", "ctx", (F.col("n") == 1).alias("single"), "p.*"), "candidates")
    rows = candidates.count()
    cuts = _splitters(candidates, rows, bucket_rows)
    wanted = candidates.groupBy(*KEY).agg(
        F.collect_list(F.struct("gram", "ctx", "single", "at", "lo", "hi")).alias("wanted"))
    suffixes = documents.join(wanted, KEY).mapInPandas(_cut(window, cuts), SUFFIX_SCHEMA)
    sorted_runs = (suffixes.repartition("bucket").sortWithinPartitions("bucket", "gram")
                   .mapInPandas(_sort_buckets(window), SPAN_SCHEMA))
    if any(c != _WHOLE for _, c in cuts):
        sorted_runs = written(sorted_runs, "runs")
        outer = sorted_runs.where("wh is not null")
        twice = outer.groupBy("wh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        runs = (sorted_runs.where("wh is null").select(*KEY, "lo", "hi")
                .unionByName(outer.join(twice, "wh").select(*KEY, "lo", "hi")))
    else:
        runs = sorted_runs.select(*KEY, "lo", "hi")
    return whole.unionByName(runs).groupBy(*KEY).agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"))


class _Codes(dict):
    """word -> its code; emptied at ``CODES`` words so that its memory is bounded."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= CODES:
            self.clear()
        self[word] = code = base64.b64encode(xxhash.xxh3_64_digest(word)[:6]).decode()
        return code


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = _Codes()
    for pdf in batches:
        yield pdf.assign(text=["".join(map(codes.__getitem__, encode(t).split())) for t in pdf["text"]])


def _passages(b: bytes, spans, words: int) -> list[tuple[int, int]]:
    """Bytes of the passages that spans of codes stand for; a span holds a repeated
    window at every place, those at a word's start count."""
    at = [m.span() for m in _WORD.finditer(b)]
    out = []
    for s in spans:
        first, last = -(-s["lo"] // CODE), s["hi"] // CODE - words
        if first <= last:
            out.append((at[first][0], at[last + words - 1][1]))
    return out


def _removed(words: int | None):
    def run(texts: pd.Series, spans: pd.Series, coded: pd.Series) -> pd.DataFrame:
        out = []
        for text, span, code in zip(texts, spans, coded):
            b = encode(text)
            kept, end, removed, n = [], 0, 0, 0
            gone = [(s["lo"], s["hi"]) for s in span] if span is not None else []
            if code is not None:
                gone += _passages(b, code, words)
            for lo, hi in sorted(gone):
                if lo > end or n == 0:
                    kept.append(b[end:lo])
                    removed += hi - lo
                    n += 1
                elif hi > end:
                    removed += hi - end
                end = max(end, hi)
            kept.append(b[end:])
            out.append((len(b), removed, n, b"".join(kept)))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   bucket_rows: int = BUCKET_ROWS, result: str = "repeats", words: int | None = None) -> DataFrame:
    """The rows of ``documents(doc_id, text, ...)`` with a struct ``result``:
    ``n_bytes`` (UTF-8 bytes of the text), ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (the other bytes, concatenated).

    A byte is removed if a string of ``window`` bytes that covers it also starts
    anywhere else, in the same row or another; overlaps count, and strings are
    judged on the input.  With ``words``, so is a byte of a passage of that many
    consecutive space words (A-Z as written, whatever separates them) that also
    starts anywhere else.  A null text is empty; texts shorter than ``window``
    and ``words`` lose nothing; a row that is repeated as a whole is a second occurrence.
    Null and repeated doc_ids are allowed (rows are told apart by id and text;
    equal rows have equal results).  Other columns pass through, one named like
    ``result`` is replaced (names beginning with ``_r`` are reserved).  An empty
    table gives an empty result.
    """
    own = documents.drop(result)
    row_key = {"_rk1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_rk2": F.xxhash64("doc_id", "text")}
    docs = own.withColumns(row_key)
    texts = docs.select(F.col("_rk1").alias("k1"), F.col("_rk2").alias("k2"), "text")
    spans = repeated_spans(texts, window, gram, bucket_rows).toDF("_rk1", "_rk2", "_rspans")
    if words is None:
        spans = spans.withColumn("_rcoded", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    else:
        codes = small_batches(texts).mapInPandas(_coded, "k1 long, k2 long, text string")
        coded = repeated_spans(codes, words * CODE, CODE_GRAM, bucket_rows).toDF("_rk1", "_rk2", "_rcoded")
        spans = spans.join(coded, ["_rk1", "_rk2"], "full")
    cut = F.pandas_udf(_removed(words), "n_bytes long, n_removed long, n_spans long, kept binary")
    return (docs.join(spans, ["_rk1", "_rk2"], "left").withColumn(result, cut("text", "_rspans", "_rcoded"))
            .select(*own.columns, result))
