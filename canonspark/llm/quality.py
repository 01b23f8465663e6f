"""Quality classifier by co-training of a text view and a metadata view.

A document is *bad* if its label says low quality or toxic.  Two classifiers
see different things: one the words of the text (sparse logistic regression
over word presence, L1) and its shape, the other the page's and the document's
metadata.  In every round both are fitted and calibrated on a held-back part of the
labels.  Between rounds both are applied to *all* unlabelled documents, and each
gives those of which it is most confident to the other one as pseudo-labels.  At
the end the calibrated views are combined by a logistic regression on the held-back
part, and all documents are scored.

Only the fit is bounded: it takes about ``fit_rows`` labelled documents (whole texts),
chosen by a hash of the id, and from each exchange the ``given`` most confident
documents of each class and view.  All pages of a document are its metadata.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.llm.textops import ALNUM_WORD_BYTES, alnum_words, coded_words, encode, small_batches, written
from canonspark.llm.url_filters import host_of

FIT_ROWS = 4000              # labelled documents that the fit takes
ROUNDS, GIVEN, CONFIDENT = 3, 300, 0.98
PAGE_LEAST = 5               # documents of the fit that have a page's category, for it to count
BLOCK = 1_000_000            # bytes of text that are scored at once
FEATURE_ROWS = 200           # documents whose features leave a task at once
PIECE = 1 << 18              # features of the fit that the driver works on at once
SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"


PREFIXES = (4, 5, 6)


def shape_of(text) -> list[float]:
    """What a text looks like, apart from its words."""
    raw = encode(text)
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, spaced = max(1, int(b[65:91].sum() + b[97:123].sum() + b[128:].sum())), raw.lower().split()
    n = max(1, len(spaced))
    again = sum(map(eq, spaced, spaced[1:])) / n
    shape = [b[65:91].sum() / letters, sum(int(b[c]) for c in SYMBOLS) / max(1, len(raw)),
             b[48:58].sum() / max(1, len(raw)), again, 1 - len(set(spaced)) / n,
             letters / n / 10, np.log1p(len(spaced)) / 10, float(len(spaced) == 0)]
    return [float(x) for x in shape]


def word_names(word: bytes) -> list[int]:
    """Features of a word: itself and its beginnings, as 64-bit names."""
    return [_name(word), *(_name(b"\0" + word[:k]) for k in PREFIXES if len(word) > k)]


def text_features(text) -> tuple[np.ndarray, list[float]]:
    """Distinct word features, and the text's shape."""
    names = {x for w in set(alnum_words(text)) for x in word_names(w)}
    return np.fromiter(names, np.int64, len(names)), shape_of(text)


class Weighted(dict):
    """word -> places of its features with a weight (mostly none), for words seen
    before; emptied at ``limit`` words so that its memory is bounded."""

    def __init__(self, model: "SparseLogit", limit: int = 50_000):
        super().__init__()
        # by the name as xxhash gives it; most words are new, so none is made signed
        self.place = {int(x) % (1 << 64): i for i, x in enumerate(model.names)}
        self.limit = limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        place, name = self.place, xxhash.xxh64_intdigest
        found = [place[x]] if (x := name(word)) in place else []
        for k in PREFIXES:
            if len(word) <= k:
                break
            if (x := name(b"\0" + word[:k])) in place:
                found.append(place[x])
        self[word] = got = tuple(found)
        return got


SHAPE = 8
_NONE = np.empty(0, np.int64)


def _slices(n: int) -> list[slice]:
    return [slice(k, min(n, k + PIECE)) for k in range(0, n, PIECE)]


class Names:
    """64-bit names in rows.  The driver holds each distinct one once and a number of 4
    bytes for every place, in an array for each time that rows were added, and reads them
    ``PIECE`` at a time."""

    def __init__(self):
        self.distinct, self.codes, self.starts = np.empty(0, np.int64), [], np.zeros(1, np.int64)

    def add(self, sizes: np.ndarray, flat: list[np.ndarray], order: np.ndarray | None = None) -> None:
        """More rows: how many names each has, and their names in arrays of any length.  ``order``: which
        of these rows are taken, one after another (a row may come twice); else all."""
        pieces = [x[k] for x in flat for k in _slices(len(x))]
        old = self.distinct
        for x in pieces:
            self.distinct = np.union1d(self.distinct, x)
        place = np.searchsorted(self.distinct, old).astype(np.int32)
        for codes in self.codes:
            for k in _slices(len(codes)):
                codes[k] = place[codes[k]]
        new, end = np.empty(sum(map(len, pieces)), np.int32), 0
        for x in pieces:
            new[end : end + len(x)] = np.searchsorted(self.distinct, x)
            end += len(x)
        if order is not None:
            ends = np.cumsum(sizes, dtype=np.int64)
            new = np.concatenate([new[:0], *(new[e - n : e] for e, n in zip(ends[order].tolist(), sizes[order].tolist()))])
            sizes = sizes[order]
        self.codes.append(new)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """Where each piece begins, and its codes."""
        first = 0
        for codes in self.codes:
            for k in _slices(len(codes)):
                yield first + k.start, codes[k]
            first += len(codes)


Piece = tuple[np.ndarray, np.ndarray, slice]


class Pieces:
    """Rows of a design in pieces of about ``PIECE`` present features: columns, how many of them each
    row has, and which of the rows these are.  A piece's columns are put together when it is read."""

    def __init__(self, cols: np.ndarray, starts: np.ndarray, at: np.ndarray):
        begins, ends = starts[at], starts[at + 1]
        self.cols, self.sizes = cols, ends - begins
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(self.sizes) // PIECE)) + 1).tolist(), len(at)]
        self.rows = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        self.runs = []  # of a piece's rows that follow one another
        for k in self.rows:
            gap = np.flatnonzero(begins[k][1:] != ends[k][:-1])
            self.runs.append([*zip(begins[k][np.append(0, gap + 1)].tolist(), ends[k][np.append(gap, -1)].tolist())])

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[Piece]:
        for k, runs in zip(self.rows, self.runs):
            yield np.concatenate([self.cols[a:b] for a, b in runs]), self.sizes[k], k


class Design:
    """Features of the sample: names that at least ``least`` rows have, as numbers in
    rows (compressed), and standardised dense columns."""

    def __init__(self, rows: Names, dense: np.ndarray, least: int = 5):
        self.size = len(rows.starts) - 1
        count = np.zeros(len(rows.distinct), np.int64)
        for _, codes in rows.pieces():
            count += np.bincount(codes, minlength=len(count))
        keep = count >= least
        self.names = rows.distinct[keep]
        number = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        self.cols, sizes, end = np.empty(int(count[keep].sum()), np.int32), np.zeros(self.size, np.int64), 0
        for first, codes in rows.pieces():
            at = number[codes]
            ok = at >= 0
            n = int(ok.sum())
            self.cols[end : end + n] = at[ok]
            end += n
            row = np.searchsorted(rows.starts, first + np.flatnonzero(ok), side="right") - 1
            if n:  # its rows follow one another
                sizes[row[0] : row[-1] + 1] += np.bincount(row - row[0])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.mean = dense.mean(axis=0) if self.size else np.zeros(dense.shape[1])
        self.scale = dense.std(axis=0) + 1e-6 if self.size else np.ones(dense.shape[1])
        self.dense = (dense - self.mean) / self.scale

    def pieces(self, at: np.ndarray) -> Pieces:
        """The rows ``at``."""
        return Pieces(self.cols, self.starts, at)


def _row_sums(pieces: Iterable[Piece], w: np.ndarray, n: int) -> np.ndarray:
    """The sum of its features' weights for each of n rows."""
    out = np.zeros(n)
    for cols, sizes, rows in pieces:
        out[rows] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=w[cols], minlength=len(sizes))
    return out


def _column_sums(pieces: Iterable[Piece], r: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """The sum of its rows' values for each of n features, in the order of the rows; added to ``out``."""
    out = np.zeros(n) if out is None else out
    for cols, sizes, rows in pieces:
        np.add.at(out, cols, np.repeat(r[rows], sizes))
    return out


@dataclass
class SparseLogit:
    """Logistic regression on present features (64-bit names) and dense columns."""

    names: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    @staticmethod
    def fit(design: Design, at: np.ndarray, y: np.ndarray, l1: float = 2e-4,
            steps: int = 150) -> tuple["SparseLogit", np.ndarray]:
        """Proximal gradient with per-feature steps (Adagrad) on the rows ``at``; the
        model and its logits for all rows of the sample."""
        w, d, bias = np.zeros(len(design.names)), np.zeros(design.dense.shape[1]), 0.0
        n = len(y)
        pieces = design.pieces(at)
        x = design.dense[at]
        gw, gd, gb = np.full(len(w), 1e-8), np.full(len(d), 1e-8), 1e-8
        for _ in range(steps if n else 0):
            z, r, g = x @ d, np.zeros(n), np.zeros(len(w))
            for piece in pieces:  # its columns are put together once a step
                k = piece[2]
                r[k] = (_sigmoid(_row_sums([piece], w, n)[k] + z[k] + bias) - y[k]) / n
                g = _column_sums([piece], r, len(w), g)
            gw += g * g
            rate = 0.3 / np.sqrt(gw)
            w -= rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
            g = x.T @ r + 1e-4 * d
            gd += g * g
            d -= 0.3 * g / np.sqrt(gd)
            gb += r.sum() ** 2
            bias -= 0.3 * r.sum() / np.sqrt(gb)
        del pieces
        z = _row_sums(design.pieces(np.arange(design.size)), w, design.size) + design.dense @ d + bias
        keep = w != 0
        return SparseLogit(design.names[keep], w[keep], d, design.mean, design.scale, float(bias)), z

    def logit(self, present: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        out = ((dense - self.mean) / self.scale) @ self.dense + self.bias if len(present) else np.empty(0)
        if len(self.names):
            for i, x in enumerate(present):
                at = np.minimum(np.searchsorted(self.names, x), len(self.names) - 1)
                out[i] += self.weights[at[self.names[at] == x]].sum()
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of y on the columns of z (Newton's method), the
    constant last."""
    x = np.column_stack([np.clip(z, -12, 12), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6]) * max(1, len(y)) ** 0.5
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def metadata(source: Column, lang: Column, n_chars: Column) -> Column:
    """Categories of a document's own columns; missing ones are left out."""
    parts = [F.concat(F.lit(name), value.cast("string")) for name, value in (
        ("source=", source), ("lang=", lang), ("length=", F.floor(F.log2(n_chars + 1))))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def page_metadata(pages: DataFrame, doc_id: Column) -> DataFrame:
    """``(doc_id, category)``, once each: host, suffix, scheme and query of all pages of a document."""
    host = host_of(F.col("url"))
    parts = F.array(*[F.concat(F.lit(name), value) for name, value in (
        ("host=", host), ("suffix=", F.element_at(F.split(host, r"\."), -1)),
        ("scheme=", F.lower(F.substring_index("url", ":", 1))),
        ("query=", F.contains("url", F.lit("?")).cast("string")))])
    rows = pages.select(doc_id.alias("doc_id"), F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("category"))
    return rows.where("doc_id is not null").distinct()


@dataclass
class CoTrained:
    text: SparseLogit
    meta: SparseLogit
    meta_weights: dict[str, float]
    combine: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray


def _name(value) -> int:
    h = xxhash.xxh64_intdigest(value)
    return h - (1 << 64) if h >> 63 else h


def _names(values) -> np.ndarray:
    return np.array([_name(v) for v in values], dtype=np.int64)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column."""
    c = column.combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    sizes = np.asarray(pc.list_value_length(c).fill_null(0))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), c.flatten()


def _names_of(rows: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many names each row has, and the names; nothing is copied."""
    sizes = [np.asarray(pc.list_value_length(c).fill_null(0), dtype=np.int64) for c in rows.chunks]
    return np.concatenate([np.empty(0, np.int64), *sizes]), [np.asarray(c.flatten(), dtype=np.int64) for c in rows.chunks]


class CoTraining:
    """The state of the two views: rows with their features, and which of them each view learns from."""

    def __init__(self, labelled: pa.Table, order: np.ndarray | None = None):
        """``labelled``: words (64-bit names), shape, meta (texts) and bad (1 or 0); ``order``: of its rows,
        else they are in a fixed order."""
        order = np.arange(len(labelled)) if order is None else order
        self.words = Names()
        self.words.add(*_names_of(labelled["words"]), order)
        # copied, as Arrow keeps all columns of a batch while one of them is held
        self.rows = labelled.drop_columns(["words"]).take(pa.array(order))
        y = self.rows["bad"].to_numpy(zero_copy_only=False).astype(float)
        # held back for calibration
        self.back = np.sort(np.random.default_rng(5).permutation(len(y))[: len(y) // 4])
        self.y = y
        own = np.setdiff1d(np.arange(len(y)), self.back)
        self.train = {v: dict(zip(own.tolist(), y[own])) for v in ("text", "meta")}

    def give(self, rows: pa.Table, view: list[str], order: np.ndarray | None = None) -> None:
        """Pseudo-labelled rows (``bad`` is the label) for the views named, row by row; ``order``: which of
        ``rows`` these are, else all."""
        first, order = len(self.rows), np.arange(len(rows)) if order is None else order
        self.words.add(*_names_of(rows["words"]), order)
        few = rows.select(self.rows.column_names).take(pa.array(order)).cast(self.rows.schema)
        self.rows = pa.concat_tables([self.rows, few])
        for i, (v, bad) in enumerate(zip(view, few["bad"].to_pylist())):
            self.train[v][first + i] = bad

    def fit(self) -> CoTrained:
        shape = np.asarray(_lists(self.rows["shape"])[1], dtype=float).reshape(-1, SHAPE)
        offsets, categories = _lists(self.rows["meta"])
        coded = categories.dictionary_encode()
        categories = coded.dictionary.to_pylist()
        cats = _names(categories)
        meta = Names()
        meta.add(np.diff(offsets), [cats[coded.indices.to_numpy()]])
        designs = {"text": Design(self.words, shape), "meta": Design(meta, np.zeros((len(self.rows), 1)))}
        strength, back = {"text": 2e-4, "meta": 1e-3}, self.back
        model, scale, z = {}, {}, {}
        for v, design in designs.items():
            at = np.array(sorted(self.train[v]), dtype=int)
            model[v], z[v] = SparseLogit.fit(design, at, np.array([self.train[v][i] for i in at.tolist()]), strength[v])
            scale[v] = calibrate(z[v][back][:, None], self.y[back])
        combine = calibrate(np.column_stack([
            z[v][back] * scale[v][0] + scale[v][1] for v in designs]), self.y[back])
        weight = dict(zip(model["meta"].names.tolist(), model["meta"].weights.tolist()))
        meta_weights = {c: weight[n] for c, n in zip(categories, cats.tolist()) if n in weight}
        return CoTrained(model["text"], model["meta"], meta_weights, combine, scale["text"], scale["meta"])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), FEATURE_ROWS):
            pdf = batch.iloc[k : k + FEATURE_ROWS]
            f = [text_features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "bad": pdf["bad"].array, "meta": pdf["meta"].array,
                                "words": [w for w, _ in f], "shape": [s for _, s in f]})


def _marked(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(
        ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("double")).alias("bad"))


def _rows_of(documents: DataFrame, chosen: DataFrame, pages: DataFrame) -> pa.Table:
    """Features of the documents ``chosen(doc_id, bad)``, a bounded number of them; of
    rows that repeat an id the one with the smallest text is taken."""
    few = F.broadcast(chosen)
    texts = (documents.select("doc_id", "text", "source", "lang", "n_chars").join(few, "doc_id")
             .groupBy("doc_id", "bad").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("d")))
    mine = pages.join(few.select("doc_id"), "doc_id", "left_semi")
    # categories of hosts that hardly any of these documents has say nothing; so a document's list is bounded
    known = mine.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGE_LEAST).select("category")
    lists = mine.join(known, "category").groupBy("doc_id").agg(F.sort_array(F.collect_list("category")).alias("c"))
    own = metadata(*[F.col(f"d.{c}") for c in ("source", "lang", "n_chars")])
    return (texts.join(lists, "doc_id", "left")
            .select("doc_id", F.col("d.text").alias("text"), "bad",
                    F.concat(own, F.coalesce("c", F.expr("cast(array() as array<string>)"))).alias("meta"))
            .mapInPandas(_features, "doc_id long, bad double, meta array<string>, words array<long>, shape array<double>")
            .toArrow())


def _ordered(rows: pa.Table) -> np.ndarray:
    """An order of its own, whatever the partitions."""
    return pc.sort_indices(rows.select(["doc_id", "bad"]), [("doc_id", "ascending"), ("bad", "ascending")]).to_numpy()


def fit(documents: DataFrame, labels: DataFrame, pages: DataFrame, fit_rows: int = FIT_ROWS,
        rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
    """Fit on about ``fit_rows`` labelled documents and, after each of ``rounds`` - 1 exchanges, on the
    ``given`` documents of each class of which each view is most confident among all
    unlabelled ones.  ``labels(doc_id, quality, toxic)``: a null counts as good,
    contradicting rows as bad; ``pages(doc_id, category)``: see ``page_metadata``."""
    marked = _marked(labels)
    part = min(1.0, fit_rows / max(1, marked.count()))
    sampled = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(2**32)) < int(2**32 * part))
    table = _rows_of(documents, sampled, pages)
    state = CoTraining(table, _ordered(table))
    del table
    pa.default_memory_pool().release_unused()
    model = state.fit()
    known = small_batches(documents).where("doc_id is not null")
    seen: set[tuple[int, str]] = set()
    for i in range(rounds - 1):
        # logits alone are joined with the labels, texts stay where they are
        scored = written(_scored(known, model, pages, []).groupBy("doc_id").agg(
            F.min("_qt").alias("text"), F.min("_qm").alias("meta")).join(marked, "doc_id", "left_anti"), "scored")
        rows, to = [], []
        for v, other in (("text", "meta"), ("meta", "text")):
            for bad, order in ((1.0, F.desc(v)), (0.0, F.asc(v))):
                sure = F.col(v) >= _LOGIT if bad else F.col(v) <= -_LOGIT
                old = [d for d, o in seen if o == other]  # bounded by what was given
                best = scored.where(sure & ~F.col("doc_id").isin(old) if old else sure).orderBy(order, "doc_id").limit(given)
                for r in best.select("doc_id").collect():
                    if (r[0], other) not in seen:
                        seen.add((r[0], other))
                        rows.append((r[0], bad))
                        to.append(other)
        if not rows:
            break
        spark = documents.sparkSession
        once = spark.createDataFrame(sorted(set(rows)), "doc_id long, bad double")
        table = _rows_of(documents, once, pages)
        place = {key: k for k, key in enumerate(zip(table["doc_id"].to_pylist(), table["bad"].to_pylist()))}
        state.give(table, to, np.array([place[r] for r in rows]))
        del table
        pa.default_memory_pool().release_unused()
        model = state.fit()
    return model


_LOGIT = float(np.log(CONFIDENT / (1 - CONFIDENT)))


def _present(data: bytes, begins: np.ndarray, places: Weighted, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of the model's features that each text of a block holds, each once."""
    code, starts, names = coded_words(data, ALNUM_WORD_BYTES)
    docs = len(begins)
    if len(code) == 0 or len(weights) == 0:
        return np.zeros(docs)
    features = [places[w] for w in names.to_pylist()]
    size = np.fromiter(map(len, features), np.int64, len(features))
    if not size.any():
        return np.zeros(docs)
    flat = np.fromiter((x for f in features for x in f), np.int64, int(size.sum()))
    first = np.cumsum(size) - size
    doc = np.searchsorted(begins, starts, side="right") - 1
    some = size[code] > 0
    pair = np.unique(doc[some] * len(names) + code[some])  # words of a text, each once
    doc, code = pair // len(names), pair % len(names)
    n = size[code]
    at = np.repeat(first[code], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    have = np.unique(np.repeat(doc, n) * len(weights) + flat[at])
    return np.bincount(have // len(weights), weights=weights[have % len(weights)], minlength=docs)


def text_logit(model: CoTrained):
    m, a = model.text, model.text_scale

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = Weighted(m)
        for texts in batches:
            z = m.logit([_NONE] * len(texts), np.array([shape_of(t) for t in texts], dtype=float).reshape(-1, SHAPE))
            raw = [encode(t) for t in texts]
            sizes = np.cumsum([0] + [len(b) + 1 for b in raw])
            cuts = [0, *(np.flatnonzero(np.diff(sizes[1:] // BLOCK)) + 1).tolist(), len(raw)]
            for x, y in zip(cuts, cuts[1:]):
                if x < y:
                    z[x:y] += _present(b" ".join(raw[x:y]), sizes[x:y] - sizes[x], places, m.weights)
            yield pd.Series(z * a[0] + a[1], dtype=float)

    return run


def _meta_weights(model: CoTrained) -> Column:
    return F.from_json(F.lit(json.dumps(model.meta_weights)), "map<string,double>")


def meta_logit(model: CoTrained, categories: Column, pages: Column | None = None) -> Column:
    """The metadata view's logit; its weights are those of the sample's categories.
    ``pages``: the summed weights of the pages' categories."""
    weights = _meta_weights(model)
    a, m = model.meta_scale, model.meta
    flat = float(m.bias - m.mean[0] / m.scale[0] * m.dense[0])
    total = F.aggregate(F.array_distinct(categories), F.lit(flat),
                        lambda acc, c: acc + F.coalesce(F.element_at(weights, c), F.lit(0.0)))
    if pages is not None:
        total = total + F.coalesce(pages, F.lit(0.0))
    return total * float(a[0]) + float(a[1])


def _scored(documents: DataFrame, model: CoTrained, pages: DataFrame, keep: list[str]) -> DataFrame:
    """Logits of both views, ``_qt`` and ``_qm``, beside ``doc_id`` and the columns ``keep``."""
    columns = [c for c in documents.columns if c in keep or c in ("doc_id", "source", "lang", "n_chars")]
    rows = documents.withColumn("_qt", text_logit(model)("text")).select(*columns, "_qt")
    side = (pages.select(F.col("doc_id").alias("_qid"), F.element_at(_meta_weights(model), F.col("category")).alias("w"))
            .where("w is not null").groupBy("_qid").agg(F.sum("w").alias("_qw")))
    # hashed on the small side, so that rows with whole texts are not sorted
    rows = rows.join(side.hint("shuffle_hash"), F.col("doc_id") == F.col("_qid"), "left")
    return rows.withColumn("_qm", meta_logit(model, metadata(*[F.col(c) for c in ("source", "lang", "n_chars")]),
                                             F.col("_qw"))).drop("_qid", "_qw")


def judge(documents: DataFrame, model: CoTrained, pages: DataFrame, keep_text: bool = True,
          result: str = "quality_score") -> DataFrame:
    """The rows of ``documents(doc_id, text, lang, source, n_chars, ...)`` with a
    struct ``result``: ``text_score``, ``meta_score`` and ``score`` (calibrated
    probability that the document is good by the text, by the metadata and by
    both) and ``kept`` (score >= 0.5).

    A null or empty text is scored by its shape; documents without a page have
    their own metadata only; nulls are missing categories.  Rows that repeat a
    doc_id are scored each.  A model fitted without labels keeps everything (0.5).
    Other columns pass through (``_q`` names are reserved);
    without ``keep_text`` the text is dropped before the metadata is joined, so
    that texts are not shuffled.  An empty table gives an empty result.
    """
    own = small_batches(documents).drop(result)
    kept = [x for x in own.columns if keep_text or x != "text"]
    rows = _scored(own, model, pages, kept)
    c = [float(x) for x in model.combine]

    def good(z: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(z))

    both = good(F.least(F.greatest(F.col("_qt"), F.lit(-12.0)), F.lit(12.0)) * c[0]
                + F.least(F.greatest(F.col("_qm"), F.lit(-12.0)), F.lit(12.0)) * c[1] + F.lit(c[2]))
    return rows.withColumn(result, F.struct(
        good(F.col("_qt")).alias("text_score"), good(F.col("_qm")).alias("meta_score"), both.alias("score"),
        (both >= 0.5).alias("kept"))).select(*kept, result)
