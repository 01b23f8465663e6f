"""Near-duplicate documents: MinHash with tensored banding, exact verification.

Per document, inside one Arrow-batched pass, the set of word shingles gives

* two collections U and V of ``tables`` band hashes (``rows`` minhashes each).
  A table key is a pair (U_i, V_j), so ``tables**2`` tables cost only
  ``2 * tables * rows`` minhashes;
* a parity sketch of four to eight bits per shingle.  The bits in which two
  sketches differ are a lower bound of the symmetric difference, so a pair
  whose bound already rules out the threshold is dropped with proof.

Then, in Spark:

1. Documents with equal sets become one class (pre-aggregation of copies).
2. A band hash that only one class has cannot be part of a shared key: keys
   are formed only from the bands a class shares with some other class.
3. Every bucket links its members to its smallest id (a star, linear in the
   bucket); survivors of the sketch are verified on full sets, and connected
   components are taken.
4. Buckets that still hold several components are compared across components
   in blocks of ``block`` members: a big bucket becomes many equal cells (its
   largest component meets the others only, so one stray member costs a linear
   pass), and a cell gives out only pairs that the sketch cannot rule out.  These are
   verified and the components taken again.  A pair inside one component
   needs no test, as only reachability is asked for.

A pair at the threshold shares no key with probability at most
``2 * (1 - t**rows)**tables`` (1e-6 at 0.8 by default).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.llm.components import components
from canonspark.llm.shingles import WordHashes, shingle_set
from canonspark.llm.textops import checkpoint, small_batches, space_words, written

TABLES, ROWS, WORDS, THRESHOLD = 14, 2, 5, 80
CELL = ["key", "kind", "lo", "hi"]
BROADCAST_IDS = 100_000  # largest id list (800 KB) that is broadcast; beyond it a shuffle join


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return (rng.integers(1, 2**62, n).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def _minhashes(s: np.ndarray, mult: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Minimum of ``s * a`` for every odd multiplier a; long sets in blocks."""
    best = None
    for i in range(0, len(s), step):
        low = (s[None, i : i + step] * mult[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def parity_sketch(s: np.ndarray) -> bytes:
    """Bit i: parity of the number of members that fall on i; a power of two of
    at least 1024 bits and at least four times the set's size."""
    bits = max(1024, 1 << int(4 * len(s) - 1).bit_length())
    hit = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").tobytes()


def fold_sketch(x: np.ndarray, nbytes: int) -> np.ndarray:
    """Halve sketches (rows of bytes) until they have ``nbytes``."""
    while x.shape[-1] > nbytes:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def ruled_out(n1, n2, differing, threshold: int):
    """Whether sets of n1 and n2 members that differ in at least ``differing``
    members have 100 * intersection < threshold * union for certain."""
    # |A u B| >= (n1 + n2 + d) / 2 and |A n B| <= (n1 + n2 - d) / 2
    d = np.maximum(differing, np.abs(n1 - n2))
    return 100 * (n1 + n2 - d) < threshold * (n1 + n2 + d)


def _profile(words: int, tables: int, rows: int):
    mult = _multipliers(2 * tables * rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle_set(space_words(text), hashes, words)
                if len(s) == 0:
                    out.append((doc_id, 0, None, None, None))
                    continue
                low = _minhashes(s, mult).reshape(2 * tables, rows)
                band = low[:, 0].copy()
                for r in range(1, rows):
                    band = band * np.uint64(0x9E3779B97F4A7C15) + (low[:, r] ^ (low[:, r] >> np.uint64(29)))
                out.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()),
                            band.astype(np.int64), parity_sketch(s)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return run


PROFILE_SCHEMA = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"


def _sketch_filter(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for n1, s1, n2, s2 in zip(pdf["n1"], pdf["s1"], pdf["n2"], pdf["s2"]):
                x, y = np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)
                size = min(len(x), len(y))
                d = int(np.bitwise_count(fold_sketch(x, size) ^ fold_sketch(y, size)).sum())
                keep.append(not ruled_out(n1, n2, d, threshold))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def _cell_pairs(pdf: pd.DataFrame, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """One cell: members of block ``side`` 0 against block 1 (or one block
    against itself), only pairs of different components."""
    comp, side = pdf["comp"].to_numpy(), pdf["side"].to_numpy()
    ids, n = pdf["id"].to_numpy(), pdf["n_shingles"].to_numpy()
    same = bool(pdf["same"].iloc[0])
    nbytes = np.array([len(x) for x in pdf["sketch"]])
    where = {z: np.flatnonzero(nbytes == z) for z in set(nbytes.tolist())}
    bits = {z: np.frombuffer(b"".join(pdf["sketch"].iloc[i]), np.uint8).reshape(len(i), z)
            for z, i in where.items()}
    found_a, found_b = [], []
    for z1, i1 in where.items():
        for z2, i2 in where.items():
            # sizes within the threshold differ by less than a factor of two
            if z2 not in (z1 // 2, z1, z1 * 2):
                continue
            rows1 = np.arange(len(i1)) if same else np.flatnonzero(side[i1] == 0)
            rows2 = np.arange(len(i2)) if same else np.flatnonzero(side[i2] == 1)
            if len(rows1) == 0 or len(rows2) == 0:
                continue
            z = min(z1, z2)
            x = fold_sketch(bits[z1][rows1], z).view(np.uint64)
            y = fold_sketch(bits[z2][rows2], z).view(np.uint64)
            j2 = i2[rows2]
            for row, i in zip(x, i1[rows1]):
                ok = (comp[j2] != comp[i]) & ~ruled_out(n[i], n[j2], 0, threshold)
                if same:
                    ok &= ids[j2] > ids[i]
                j = np.flatnonzero(ok)
                if len(j):
                    d = np.bitwise_count(y[j] ^ row).sum(axis=1, dtype=np.int64)
                    j = j2[j[~ruled_out(n[i], n[j2[j]], d, threshold)]]
                    found_a.append(np.full(len(j), ids[i]))
                    found_b.append(ids[j])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _cross_pairs(threshold: int):
    """Cells arrive sorted; one that crosses an Arrow batch is carried over.  A
    cell holds two blocks at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(cells: pd.DataFrame) -> pd.DataFrame:
            out = [_cell_pairs(c, threshold) for _, c in cells.groupby(CELL, sort=False)]
            a = np.concatenate([x for x, _ in out])
            b = np.concatenate([y for _, y in out])
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf) == 0:
                continue
            open_cell = (pdf[CELL] == pdf[CELL].iloc[-1]).all(axis=1).to_numpy()
            rest = pdf[open_cell]
            if not open_cell.all():
                yield pairs(pdf[~open_cell])
        if rest is not None and len(rest):
            yield pairs(rest)

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "members": [
                shingle_set(space_words(t), hashes, words).tobytes() for t in pdf["text"]]})

    return run


def _exact(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["m1"], pdf["m2"]):
                s1, s2 = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s1, s2, assume_unique=True))
                keep.append(100 * both >= threshold * (len(s1) + len(s2) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def verify(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.  ``pairs``
    is checkpointed; a list of ids of proven size is broadcast to the scan of
    the texts, a longer one is joined by shuffle."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(
        pairs.select(F.col("b").alias("doc_id"))).distinct()
    n = ids.count()
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    sets = checkpoint(docs.join(ids, "doc_id", "left_semi")
                      .mapInPandas(_sets_of(words), "id long, members binary"))
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("m1"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("m2"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(_exact(threshold), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = WORDS, threshold: int = THRESHOLD,
                    tables: int = TABLES, rows: int = ROWS, block: int = 4096) -> DataFrame:
    """``documents(doc_id, text, ...)`` -> one row per input row: ``doc_id``,
    ``n_shingles`` (set size), ``component_id`` (smallest doc_id reachable over
    links, itself included), ``kept`` (doc_id = component_id), ``class_id``
    (smallest doc_id with the same set).

    Words are space words of the lower-cased (A-Z) text.  A text with fewer
    words than a shingle is one shingle; null, empty and wordless texts have an
    empty set and are linked with nothing.  A null doc_id is linked with
    nothing: its component is null and it is kept.  Rows that repeat a doc_id
    are judged each by its own text.  Other columns are ignored; an empty table gives an
    empty result.
    """
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("text").cast("string").alias("text"))
    prof = checkpoint(docs.mapInPandas(_profile(words, tables, rows), PROFILE_SCHEMA))
    linked = prof.where("n_shingles > 0 and doc_id is not null")
    reps = checkpoint(linked.groupBy("set_hash").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    sketches = reps.select("id", "n_shingles", "sketch")

    # bands that some other class has too
    bands = reps.select("id", F.posexplode("bands").alias("i", "h"))
    # (written, so that the join reads two plain shuffles and can split a hot band)
    shared = written(bands.groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "bands")
    own = bands.join(shared, ["i", "h"]).groupBy("id").agg(
        F.collect_list(F.when(F.col("i") < tables, F.struct("i", "h"))).alias("u"),
        F.collect_list(F.when(F.col("i") >= tables, F.struct("i", "h"))).alias("v"))
    keys = checkpoint(
        own.select("id", F.explode("u").alias("u"), "v").select("id", "u", F.explode("v").alias("v"))
        .select("id", F.xxhash64("u.i", "v.i", "u.h", "v.h").alias("key")))

    # star of every bucket, sketch, full sets
    buckets = written(keys.groupBy("key").agg(
        F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    star = (keys.join(buckets, "key").select("a", F.col("id").alias("b")).where("a != b").distinct())
    s1 = sketches.select(F.col("id").alias("a"), F.col("n_shingles").alias("n1"), F.col("sketch").alias("s1"))
    s2 = sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("s2"))
    likely = checkpoint(star.join(s1, "a").join(s2, "b")
                        .mapInPandas(_sketch_filter(threshold), "a long, b long").distinct())
    links = checkpoint(verify(likely, docs, words, threshold))
    comp = components(links)

    # buckets that still hold several components, in blocks
    rep_comp = checkpoint(sketches.join(comp, "id", "left").withColumn(
        "comp", F.coalesce("component", "id")).drop("component"))
    members = keys.join(rep_comp.select("id", "comp"), "id")
    by_comp = members.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("id"), F.lit(2**40))).alias("sum1"),
        F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2**40))).alias("sum2"))
    open_buckets = by_comp.groupBy("key").agg(
        F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.sum("sum1").alias("sum1"), F.sum("sum2").alias("sum2"),
        F.max(F.struct("n", "comp")).alias("major"))
    # buckets of two were decided by their star; of buckets with the same members one is enough
    open_buckets = (open_buckets.where("comps > 1 and n > 2")
                    .groupBy("n", "sum1", "sum2").agg(F.min(F.struct("key", "major")).alias("b"))
                    .select("b.key", F.col("b.major.comp").alias("major"),
                            F.ceil(F.col("b.major.n") / block).cast("int").alias("chunks"),
                            F.ceil((F.col("n") - F.col("b.major.n")) / block).cast("int").alias("blocks")))
    # (written, so that the join reads two plain shuffles)
    open_buckets = written(open_buckets, "open")

    # members of the largest component need no pairs among themselves: their chunks meet
    # the blocks of the others only
    def cell(kind: int, lo: Column, hi: Column, side: Column, same: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"),
                        side.cast("int").alias("side"), same.alias("same"))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    own = F.pmod(F.xxhash64("id"), F.when(F.col("comp") == F.col("major"), F.col("chunks")).otherwise(F.col("blocks")))
    no = F.lit(False)
    minor = F.concat(
        F.transform(upto("blocks"), lambda o: cell(
            0, F.least(F.col("own"), o), F.greatest(F.col("own"), o), F.col("own") > o, F.col("own") == o)),
        F.transform(upto("chunks"), lambda c: cell(1, F.col("own"), c, F.lit(0), no)))
    major = F.transform(upto("blocks"), lambda o: cell(1, o, F.col("own"), F.lit(1), no))
    placed = (members.join(open_buckets, "key").withColumn("own", own.cast("int"))
              .select("key", "id", F.explode(F.when(F.col("comp") == F.col("major"), major).otherwise(minor)).alias("cell"))
              .select("key", "id", "cell.*"))
    cells = placed.join(rep_comp, "id").select(*CELL, "id", "n_shingles", "sketch", "comp", "side", "same")
    cross = checkpoint(cells.repartition(*CELL).sortWithinPartitions(*CELL)
                       .mapInPandas(_cross_pairs(threshold), "a long, b long").distinct().join(likely, ["a", "b"], "left_anti"))
    more = checkpoint(verify(cross, docs, words, threshold))
    final = components(links.unionByName(more))

    classes = (reps.select("set_hash", "id").join(final, "id", "left")
               .select("set_hash", F.col("id").alias("class_id"),
                       F.coalesce("component", "id").alias("component_id")))
    found = (linked.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash")
             .select("doc_id", "n_shingles", "component_id",
                     (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id"))
    alone = prof.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"),
        F.col("doc_id").alias("class_id"))
    return found.unionByName(alone)
