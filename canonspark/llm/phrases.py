"""Phrase collocations of each language, mined by sampling with a negative border.

A phrase is at most as frequent as its parts, so the frequent phrases can be
found from a guess:

1. A hash *sample* of the documents proposes the phrases that reach a lowered
   threshold in it.
2. A *full pass* counts, exactly, the proposed phrases and their negative border:
   every phrase that is not proposed while its first and its last words are.
   (Phrases of the border that don't occur have no rows.)
3. A frequent phrase of the border is a *failure* of the sample: its extensions
   were not counted.  It joins the proposal, and a further pass counts what the
   border has gained, and with every phrase that it counts also that phrase's
   extensions, so that it leaves no failure: the next border is closed.  The result
   is exact whatever the sample held.

Tasks ask for membership of the proposal in a bit table of fixed size, the only
thing that is broadcast; a false member only means that more is counted.  Blocks of
text are split, coded and counted as arrays; the counts of equal phrases are
summed by text, never by hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canonspark.llm.bittable import BITS, Members, bit_table
from canonspark.llm.textops import coded_words, encode, small_batches, written

SAMPLE, LEAST, LONGEST, TOP = 8, 30, 4, 2000
LANG = "und"
BLOCK = 3_000_000  # bytes of text that a task counts at once (about 150 MB of arrays)

ROWS = 32_768      # counts in a batch that a task gives out

_SPACE, _CUT = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.array([1 if c in _SPACE else 2 if c in _CUT else 0 for c in range(256)], np.uint8)
_CUTS = re.compile(b"[" + re.escape(_CUT) + b"]")
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
COUNT_SCHEMA = "key string, n long"  # the phrase, a tab, the language: one short key to group by


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    return h ^ (h >> np.uint64(29))


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return _mixed(h * _MIX1 + word)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _words(data: bytes):
    """Code of every word, number of its piece, and the words of the codes."""
    code, starts, names = coded_words(data, _KIND == 0)
    piece = np.cumsum(_KIND[np.frombuffer(data, np.uint8)] == 2, dtype=np.int32)[starts]
    return code, piece, names


def _counted(code: np.ndarray, places: np.ndarray, k: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes, word by word, and counts of the phrases of k words at ``places``."""
    key, words = code[places], [np.arange(size)]
    for j in range(1, k):
        unique, key, n = np.unique(key * size + code[places + j], return_inverse=True, return_counts=True)
        words = [w[unique // size] for w in words] + [unique % size]
    return words, n


def _count_block(lang: str, data: bytes, low: int, high: int, known: tuple[int, ...], now: Members | None,
                 before: Members | None):
    """Counts of the phrases of ``low`` to ``high`` words whose first and last words are
    members of ``now`` (phrases of lengths that are not ``known`` all are).  With ``before``,
    less those that it let through, and what is counted is a member for longer ones."""
    code, piece, names = _words(data)
    if len(code) == 0:
        return
    size = len(names)
    word = _word_hashes(lang, names.to_pylist())
    if low == 1:
        yield 0, pa.array([""]), np.array([len(code)])
        yield 1, names.cast(pa.string()), np.bincount(code, minlength=size)

    def members(table, k, h):
        return np.ones(len(h), bool) if table is None or k not in known else table.has(h)

    at = np.arange(len(code), dtype=np.int32)   # places of phrases of k words that may grow
    new, old = members(now, 1, word)[code], (before.has(word)[code] if before else np.zeros(len(code), bool))
    h = word[code]
    for k in range(2, high + 1):
        # places where the phrases of k - 1 words at i and i + 1 are both members, in one piece
        follows = np.flatnonzero((at[1:] == at[:-1] + 1) & new[1:] & new[:-1])
        start = at[follows]
        same = piece[start] == piece[start + k - 1]
        follows, start = follows[same], start[same]
        if len(start) == 0:
            return
        was = old[follows] & old[follows + 1]
        fresh = start if before is None else start[~was]
        if k >= low and len(fresh):
            words, n = _counted(code, fresh, k, size)
            parts = [names.take(pa.array(w)).cast(pa.string()) for w in words]
            yield k, pc.binary_join_element_wise(*parts, " "), n
        if k == high:
            return
        h = _extend(h[follows], word[code[start + k - 1]])
        new = members(now, k, h)
        if before is None:
            old = np.zeros(len(h), bool)
        else:
            old = was & before.has(h)
            new |= ~was
        at = start


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of a language put together, a line end between them; a text that is longer
    than a block is cut at the ends of pieces (one that has none stays whole)."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            b = encode(text.as_py())
            while len(b) > BLOCK:
                m = _CUTS.search(b, BLOCK)
                if m is None:
                    break
                yield lang, b[: m.start()]
                b = b[m.end():]
            held.setdefault(lang, []).append(b)
            size += len(b) + 1
            if size > BLOCK:
                yield from ((x, b"\n".join(texts)) for x, texts in held.items())
                held, size = {}, 0
    yield from ((x, b"\n".join(texts)) for x, texts in held.items())


def _counter(low: int, high: int, known: tuple[int, ...], now, before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [None if t is None else Members(t.value) for t in (now, before)]
        for lang, data in _blocks(batches):
            for k, phrase, n in _count_block(lang, data, low, high, known, *tables):
                for at in range(0, len(phrase), ROWS):
                    key = pc.binary_join_element_wise(phrase[at:at + ROWS], lang, "\t")
                    yield pa.RecordBatch.from_arrays([key, pa.array(n[at:at + ROWS].astype(np.int64))], names=["key", "n"])

    return run


def _counts(texts: DataFrame, low: int, high: int, known=(), now=None, before=None, least: int = 1) -> DataFrame:
    rows = small_batches(texts).mapInArrow(_counter(low, high, tuple(known), now, before), COUNT_SCHEMA)
    # no phrase holds a tab
    phrase = F.substring_index("key", "\t", 1)
    sums = rows.groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("key").startswith("\t"))
    return sums.select(F.substring("key", F.length(phrase) + 2, F.length("key")).alias("lang"),
                       F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("k"), phrase.alias("phrase"), "n")


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, np.uint64)
    for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        w = _word_hashes(lang, phrase.encode("utf-8", "surrogatepass").split(b" "))
        h = w[:1]
        for j in range(1, len(w)):
            h = _extend(h, w[j:j + 1])
        out[i] = h[0]
    return out


def _bits(phrases: DataFrame, bits: int) -> np.ndarray:
    return bit_table(phrases.select("lang", "phrase"), _phrase_hashes, bits)


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE,
                     lowered: int | None = None, bits: int = BITS) -> DataFrame:
    """``lang, k, phrase, n``: every phrase of 1 to ``longest`` words with its exact count of
    at least ``least`` in its language, and a row with k = 0 and the language's words.

    ``sample``: one document in so many (by hash) proposes phrases, those with at least
    ``lowered`` occurrences in it (half of what ``least`` amounts to there by default).
    Both change the work, not the result."""
    spark: SparkSession = documents.sparkSession
    sc = spark.sparkContext
    lowered = lowered or max(1, least // (2 * sample) + 1)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(LANG)).alias("lang")
    texts = documents.where("text is not null").select(lang, "text")
    key = [c for c in ("doc_id", "text") if c in documents.columns][:1]
    some = documents.where("text is not null").where(F.pmod(F.xxhash64(*key), F.lit(sample)) == 0).select(lang, "text")

    first = written(_counts(some, 1, min(2, longest), least=lowered).where("k > 0"), "proposed")
    table = _bits(first, bits)
    proposed = first
    if longest > 2:
        now = sc.broadcast(table)
        more = written(_counts(some, 3, longest, (1, 2), now, least=lowered), "proposed")
        now.unpersist()
        table = table | _bits(more, bits)
        proposed = first.unionByName(more)

    known = tuple(range(1, longest))
    now = sc.broadcast(table)
    found = written(_counts(texts, 1, longest, known, now, least=least), "frequent")
    failed = written(found.where(F.col("k").between(1, longest - 1)).join(proposed, ["lang", "phrase"], "left_anti"), "failed")
    if not failed.isEmpty():
        before, now = now, sc.broadcast(table | _bits(failed, bits))
        found = found.unionByName(written(_counts(texts, 2, longest, known, now, before, least=least), "frequent"))
    return found


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 sample: int = SAMPLE, lowered: int | None = None, bits: int = BITS) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of every language of
    ``documents(text, lang)``: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are split into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs, A-Z lower-cased; phrases don't cross pieces.  A null text has no words, a
    null lang is ``und``.  ``a`` counts the phrase, ``n`` the language's words.  Cutting a
    phrase after k words, ``l`` and ``r`` count the parts and the score is
    floor(2,000,000 a / (l + r)); the lowest cut counts (ties: the smallest k).  A phrase
    inside a longer one that is at least 0.8 times as frequent is dropped.  Order: score,
    then a, descending, then the phrase by bytes.  Repeated rows count as often as they
    stand; other columns take no part, an empty table gives no rows."""
    found = written(frequent_phrases(documents, least, longest, sample, lowered, bits), "found")
    words = F.split("phrase", " ")

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    several = found.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"))
    cut = several.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    cut = cut.select("lang", "phrase", "a", "c", part(F.lit(1), F.col("c")).alias("left"),
                     part(F.col("c") + 1, F.col("k") - F.col("c")).alias("right"))
    single = found.where("k > 0").select("lang", "phrase", "n")
    cut = (cut.join(single.toDF("lang", "left", "l"), ["lang", "left"])
           .join(single.toDF("lang", "right", "r"), ["lang", "right"]))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = (cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase")
            .agg(F.min(F.struct("score", "c", "l", "r")).alias("cut"), F.max("a").alias("a")))
    place = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), "
                             "s -> array_join(slice(w, s, m), ' '))))"))
    inner = several.where("k > 2").select("lang", F.col("a").alias("longer"), place.alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = (best.join(inner, ["lang", "phrase"], "left")
            .where("longer is null or 100 * longer < 80 * a").select("lang", "phrase", "a", "cut.*"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = found.where("k = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                             "n", "score")
