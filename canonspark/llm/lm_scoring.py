"""Log-likelihood of whole documents under a gated recurrent language model.

1. *Counts.*  Words of all training documents are counted in the tasks and summed
   by a grouped sum.  The vocabulary stays a distributed table.
2. *Head.*  The most frequent words, at most ``head`` of them, travel to the
   tasks; the first ``short`` are the network's short list, the others lie in
   classes of about equal mass.  All words beyond the head are one class.
3. *Coding.*  One pass splits the texts and writes them as the network's numbers.
   Words beyond the head are given out with their number in the document and
   joined with the counts, which adds their part of both scores.
4. *Training.*  The network (see ``gru``) learns from all training documents.  They are
   dealt to shards by hash, one for every ``SHARD_WORDS`` words, and read in a fixed
   order; each shard starts with the same weights, and the results are averaged by
   words learned.  So the weights follow from the table, not from its partitions.
5. *Scoring.*  Every document whole, with its state carried across windows.  A word
   is charged its class and, inside the class, its output (short list) or its
   share of the counts.

P(word) = P(class | state) * P(word | class [, state]); inside the last class a
word has (c + 1) / (sum of c + number of words + 1), an unknown word counts as one
more word of it.  So the model is a distribution over the known words, the end
mark and one unknown word, as the base is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.llm.gru import Model, Shape, pack, start, unpack
from canonspark.llm.textops import SPACE_WORD_BYTES, coded_words, small_batches, written

END = b" "            # the end mark; no word holds a space
HEAD = 100_000        # words that travel to the tasks (about 3 MB)
ROUNDS = 1            # each over all training documents
SHARD_WORDS = 8_000_000  # words that one copy of the network learns from in a row
BATCH_WORDS = 4_000_000  # words that a task scores at once
BLOCK = 8_000_000     # bytes of text that are split at once
COUNT_ROWS = 1_000_000  # counts that a task holds before it gives them out
FIXED = 1 << 24       # weights are summed in fixed point


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Rows, their texts put together, and the byte at which each begins."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()
        sizes = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(sizes[1:] // BLOCK)) + 1).tolist(), len(texts)] if texts else [0]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a), b"\n".join(texts[a:b]), sizes[a:b] - sizes[a]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words; those of several blocks are put together before they leave it."""
    held: list[pa.Table] = []

    def together() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            held.clear()
            yield from t.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=65_536)

    for rows, data, _ in _blocks(batches):
        code, _, names = coded_words(data, SPACE_WORD_BYTES)
        held.append(pa.table({"word": names, "n": pa.array(np.bincount(code, minlength=len(names)), pa.int64())}))
        held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([len(rows)], pa.int64())}))
        if sum(map(len, held)) > COUNT_ROWS:
            yield from together()
    yield from together()


def word_counts(training: DataFrame) -> DataFrame:
    """``(word binary, n long)`` of all texts, the end mark included."""
    return (training.select("text").mapInArrow(_count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """The head: a place for every word, and by place (the last entry stands for the
    words beyond the head) its count, the number by which the network knows it and
    the natural log of its share of its class."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, size: int, shape: Shape):
        # the end mark is the first place
        words = sorted(words, key=lambda w: (w[0] != END, -w[1], w[0]))
        n, bands = len(words), shape.others - 1
        self.shape, self.total, self.size = shape, total, size
        self.place = {w: i for i, (w, _) in enumerate(words)}
        self.head = pa.array([w for w, _ in words], pa.binary())
        self.count = np.array([c for _, c in words] + [0], dtype=np.int64)
        self.rest = shape.short + bands
        self.number = np.full(n + 1, self.rest, dtype=np.int32)
        self.share = np.zeros(n + 1)
        short = min(n, shape.short)
        self.number[:short] = np.arange(short)
        middle = self.count[short:n]
        ahead = np.cumsum(middle) - middle
        band = np.minimum(bands - 1, ahead * bands // max(1, int(middle.sum())))
        band_mass = np.bincount(band, weights=middle, minlength=bands)
        self.number[short:n] = shape.short + band
        self.share[short:n] = np.log(middle / np.maximum(1, band_mass[band]))
        self.rest_total = total - int(self.count.sum()) + size - n + 1
        per = np.zeros(shape.short)
        per[:short] = self.count[:short]
        per = per.reshape(shape.short_classes, shape.per_class)
        masses = np.concatenate([per.sum(axis=1), band_mass, [self.rest_total]]) + 0.5
        self.class_log_p = np.log(masses / masses.sum())
        self.word_log_p = np.log((per + 0.5) / (per + 0.5).sum(axis=1, keepdims=True)).ravel()

    def places(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """Of each word its place in the head, -1 beyond it."""
        at = pc.index_in(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()), value_set=self.head)
        return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return self.number[self.places(words)]


def vocabulary(counts: DataFrame, head: int, shape: Shape) -> Vocabulary:
    """Size, total and the words above the smallest frequency step that leaves at
    most ``head`` of them; frequencies are cut into steps of about 12 %."""
    step = F.floor(F.log2("n") * 6)
    rows = sorted(((r["step"], r["words"], r["total"]) for r in counts.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("total")).collect()), reverse=True)
    size, total, taken, least = sum(r[1] for r in rows), sum(r[2] for r in rows), 0, None
    for s, words, _ in rows:
        if taken + words > head:
            break
        taken, least = taken + words, s
    top = counts.where((step >= least) | (F.col("word") == F.lit(END))) if least is not None else counts.where(
        F.col("word") == F.lit(END))
    return Vocabulary([(bytes(r["word"]), r["n"]) for r in top.collect()], total, size, shape)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double"
CODED = "rid long, doc_id long, held_out boolean, shard long, place long, n_tokens long, n_known long, base double, " \
        "lm double, codes binary, words array<binary>, times array<long>"


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)


def _coder(vocab, shards: int):
    """Texts as the network's numbers, with all that doesn't depend on its state.  Words stay
    in Arrow's arrays: most of a large table's words are beyond the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        base_log = np.log10((v.count + 1) / (v.total + v.size + 1))
        base_log[-1] = 0.0  # the words beyond the head are joined later
        share = v.share / math.log(10)
        end = v.place.get(END, -1)
        for rows, data, begins in _blocks(batches):
            code, starts, names = coded_words(data, SPACE_WORD_BYTES)
            at = v.places(names)[code]
            doc = np.searchsorted(begins, starts, side="right") - 1
            docs, many = len(rows), max(1, len(names))
            first = np.searchsorted(doc, np.arange(docs + 1))
            # the end mark stands after each text's words
            numbers = np.insert(v.number[at].astype("<u2"), first[1:], v.number[end].astype("<u2"))
            ends = (2 * (first + np.arange(docs + 1))).astype(np.int32)
            rare = np.flatnonzero(at < 0)
            pair, times = np.unique(doc[rare] * many + code[rare], return_counts=True)
            size = np.bincount(pair // many, minlength=docs)
            words = names.take(pa.array(pair % many))
            if end < 0:  # without training documents the end mark is unknown
                last = np.cumsum(size)
                words = pa.array(np.insert(np.array(words.to_pylist(), dtype=object), last, END), pa.binary())
                times, size = np.insert(times, last, 1), size + 1
            place = rows.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([
                rows.column("rid"), rows.column("doc_id"), rows.column("held_out"),
                pa.array(place % shards, pa.int64()), rows.column("place"),
                pa.array(np.diff(first) + 1, pa.int64()),
                pa.array(np.bincount(doc[at >= 0], minlength=docs) + int(end >= 0), pa.int64()),
                pa.array(np.bincount(doc, weights=base_log[at], minlength=docs) + base_log[end]),
                pa.array(np.bincount(doc, weights=share[at], minlength=docs) + share[end]),
                pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(ends), pa.py_buffer(numbers)]),
                _lists(words, size), _lists(pa.array(times, pa.int64()), size)],
                names=[c.split()[0] for c in CODED.split(", ")])

    return run


def _trainer(weights, shape: Shape):
    """Rows come shard by shard; each shard learns from the same start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, memory, docs, waiting, words, shard = None, {}, [], 0, 0, None

        def learn():
            nonlocal words, docs, waiting
            words += model.train(docs, memory=memory)
            docs, waiting = [], 0

        def result() -> pd.DataFrame:
            # fixed point, so that the sum doesn't depend on its order
            flat = np.rint(pack(model.p).astype(np.float64) * FIXED).astype(np.int64)
            return pd.DataFrame({"i": np.arange(len(flat)), "w": flat, "n": words})

        for pdf in batches:
            for own, codes in zip(pdf["shard"], pdf["codes"]):
                if own != shard:
                    if model is not None:
                        learn()
                        yield result()
                    model, memory, words, shard = Model(unpack(weights.value, shape), shape), {}, 0, own
                docs.append(np.frombuffer(codes, "<u2"))
                waiting += len(docs[-1])
                if waiting >= SHARD_WORDS:
                    learn()
        if model is not None:
            learn()
            yield result()

    return run


def train(coded: DataFrame, vocab: Vocabulary, shards: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds of averaging over the shards, by words learned; the
    driver holds one weight vector (about 50,000 numbers) at a time.  Shards follow
    from the documents, not from where they lie."""
    spark, shape = coded.sparkSession, vocab.shape
    flat = pack(start(shape, vocab.word_log_p, vocab.class_log_p))
    rows = (coded.where("not held_out").select("shard", "place", "doc_id", "codes")
            .repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "codes"))
    for _ in range(rounds):
        weights = spark.sparkContext.broadcast(flat)
        each = small_batches(rows).mapInPandas(_trainer(weights, shape), "i long, w long, n long")
        got = (each.groupBy("i").agg(F.sum(F.col("w").cast("decimal(20,0)") * F.col("n").cast("decimal(12,0)")).alias("w"),
                                     F.sum("n").alias("n"))
               .select("i", (F.col("w").cast("double") / F.col("n") / FIXED).alias("w")).toPandas())
        if len(got):
            flat = np.zeros(len(flat))
            flat[got["i"].to_numpy()] = got["w"].to_numpy()
        weights.unpersist()
    return flat.astype(np.float32)


def _scorer(weights, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(unpack(weights.value, shape), shape)
        held: list[pa.RecordBatch] = []
        docs: list[np.ndarray] = []
        waiting = 0

        def finish() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            lm = rows["lm"].to_numpy() + model.score(docs) / math.log(10)
            yield from rows.set_column(rows.column_names.index("lm"), "lm", pa.array(lm)).to_batches()

        for batch in batches:
            held.append(batch.drop_columns(["codes"]))
            docs += [np.frombuffer(c, "<u2") for c in batch.column("codes").to_pylist()]
            waiting += int(batch.column("n_tokens").to_numpy().sum())
            if waiting >= BATCH_WORDS:
                yield from finish()
                held, docs, waiting = [], [], 0
        if held:
            yield from finish()

    return run


def score(documents: DataFrame, head: int = HEAD, rounds: int = ROUNDS, shape: Shape = Shape()) -> DataFrame:
    """``documents(doc_id, text, ...)`` -> one row per input row: ``doc_id``,
    ``held_out``, ``n_tokens`` (words and one end mark), ``n_known`` (tokens that the
    training documents hold), ``train_tokens``, ``base_score`` (log10 of add-one
    unigrams) and ``score`` (log10 of the model).

    Words are space words of the lower-cased (A-Z) text; a null text is empty and
    has the end mark alone.  Training documents are those not held out, see
    ``held_out``; a null doc_id trains.  Rows that repeat count and are scored each.
    Other columns are ignored.  Without training documents every token is unknown;
    an empty table gives an empty result.
    """
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id")))
    counts = written(word_counts(training), "counts")
    vocab = vocabulary(counts, head, shape)
    # one shard for so many words: a number that follows from the texts alone
    shards = max(1, math.ceil(vocab.total / SHARD_WORDS))
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                       held_out(F.col("doc_id")).alias("held_out"),
                       F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("place"), "text")
    # written: the texts are split once, training and scoring read numbers
    coded = written(rows.mapInArrow(_coder(sc.broadcast(vocab), shards), CODED), "coded")
    flat = train(coded, vocab, shards, rounds)
    lines = coded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "codes")
    scored = lines.mapInArrow(_scorer(sc.broadcast(flat), shape), SCORED)
    rare = coded.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    tail = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.col("times") * (n > 0).cast("long")).alias("known"),
        F.sum(F.col("times") * F.log10(n + 1.0)).alias("logs"), F.sum("times").alias("times"))
    base_size, rest = math.log10(vocab.total + vocab.size + 1), math.log10(vocab.rest_total)

    def plus(c: str, size: float) -> Column:
        return F.col(c) + F.coalesce(F.col("logs") - F.col("times") * size, F.lit(0.0))

    return (scored.join(tail, "rid", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    F.lit(vocab.total).cast("long").alias("train_tokens"),
                    plus("base", base_size).alias("base_score"), plus("lm", rest).alias("score")))
