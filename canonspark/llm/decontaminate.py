"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items are cut into windows of 13 consecutive alphanumeric words
(an item of fewer words is one window).  A text is normalised to its words
joined by single spaces, with one space at either end, and so is every window;
an occurrence of the window's words is then an occurrence of its bytes.

Search of one text: windows of similar length form a *band* with its own
tables, so that one short item does not spoil the jumps of the others.  For the
first m bytes of a band's patterns (m = the shortest one),

* the shift table tells for every block of B bytes how far its last
  occurrence in some pattern is from byte m; a block that no pattern holds lets
  the search jump m - B + 1 bytes;
* where the shift is 0, the block is a suffix hash: its bucket maps the first
  m bytes of patterns to the patterns, which are compared byte by byte.

Texts stay where they are: the search is one pass over the rows, and only the
pattern tables travel.  They are cut into parts of at most ``part`` windows;
each part is a pass over the rows as the last one wrote them, so that the driver and
the tasks hold one part at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonspark.llm.textops import alnum_words, small_batches, written

WINDOW = 13
PART = 100_000  # windows of one pass (about 10 MB of tables)
BLOCK = 8       # bytes of a block; shorter for patterns of fewer bytes


class WuManber:
    """Tables for a set of patterns (bytes -> any value)."""

    def __init__(self, patterns: dict[bytes, object], block: int = BLOCK):
        self.m = m = min(map(len, patterns))
        self.block = b = min(block, m)
        self.jump = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[bytes, object]]]] = defaultdict(dict)
        for p, value in patterns.items():
            for end in range(b, m + 1):
                x = p[end - b : end]
                self.shift[x] = min(self.shift.get(x, self.jump), m - end)
            self.buckets[p[m - b : m]].setdefault(p[:m], []).append((p, value))

    def find(self, text: bytes) -> Iterator[tuple[int, bytes, object]]:
        """(start, pattern, value) of every occurrence."""
        m, b, shift, jump = self.m, self.block, self.shift, self.jump
        end, n = m, len(text)
        get = shift.get
        while end <= n:
            s = get(text[end - b : end], jump)
            if s:
                end += s
                continue
            start = end - m
            for p, value in self.buckets[text[end - b : end]].get(text[start:end], ()):
                if text.startswith(p, start):
                    yield start, p, value
            end += 1


def banded(patterns: dict[bytes, object]) -> list[WuManber]:
    """One searcher for each band of lengths [2**i, 2**(i+1))."""
    bands: dict[int, dict[bytes, object]] = defaultdict(dict)
    for p, v in patterns.items():
        bands[len(p).bit_length()][p] = v
    return [WuManber(x) for _, x in sorted(bands.items())]


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows(words: list[bytes], size: int) -> set[bytes]:
    return {joined(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _windows_of(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, w) for i, t in zip(pdf["item_id"], pdf["text"]) for w in sorted(windows(alnum_words(t), size))]
            yield pd.DataFrame(rows, columns=["item_id", "pattern"])

    return run


def _search(searchers: list[WuManber]):
    def one(text, spans, items) -> tuple[int, list[int], list[str]]:
        words = alnum_words(text)
        line = joined(words)
        hit = list(spans) if spans is not None else []
        found = set(items) if items is not None else set()
        for s in searchers:
            at = first = 0
            for start, pattern, ids in s.find(line):
                # a match begins at the space before word `first`; starts never fall
                first += line.count(b" ", at, start)
                at = start
                hit += (first, first + pattern.count(b" ") - 1)
                found.update(ids)
        return len(words), _merged(hit), sorted(found)

    def run(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out = [one(*x) for x in zip(text, before["spans"], before["items"])]
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return run


def _merged(flat: list[int]) -> list[int]:
    """Disjoint word ranges [first, end) as a flat list, from overlapping ones."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


RESULT = "n_words long, spans array<long>, items array<string>"


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = PART,
                  result: str = "benchmark_hits") -> DataFrame:
    """The rows of ``documents(text, ...)`` with a struct ``result``: ``n_words``,
    ``n_hit`` (words inside any occurrence of a window), ``spans`` (disjoint hit
    word ranges, flat: first, end, first, end ...), ``items`` (item_ids with an
    occurring window, as strings, sorted) and ``contaminated`` (n_hit > 0 and
    20 * n_hit >= n_words).

    Words are alphanumeric words of the lower-cased (A-Z) text.  Null and empty
    texts and items have no words and no windows; a null item_id is the empty
    string; items that repeat a window are all named, repeated item_ids once.
    Other columns pass through, one named like ``result`` is replaced; empty
    tables are allowed on either side.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.col("text").cast("string").alias("text"))
    patterns = written(
        items.mapInPandas(_windows_of(window), "item_id string, pattern binary")
        .groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("ids")), "windows")
    own = [c for c in documents.columns if c != result]
    df = small_batches(documents).select(*own).withColumn(result, F.expr(
        "named_struct('n_words', 0L, 'spans', cast(array() as array<long>), 'items', cast(array() as array<string>))"))
    n = patterns.count()
    parts = max(1, -(-n // part))
    for i in range(parts):
        if i:
            df = written(df, "searched")  # each part is a plan, and a table in memory, of its own
        mine = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i)
        table = {bytes(r["pattern"]): tuple(r["ids"]) for r in mine.collect()}
        search = F.pandas_udf(_search(banded(table)), RESULT)
        df = df.withColumn(result, search("text", result))
    r = F.col(result)
    # spans are flat pairs: the sum of ends less the sum of starts
    hit = F.aggregate(F.transform(r["spans"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                      F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(result, F.struct(
        r["n_words"].alias("n_words"), hit.alias("n_hit"), r["spans"].alias("spans"), r["items"].alias("items"),
        ((hit > 0) & (20 * hit >= r["n_words"])).alias("contaminated")))

