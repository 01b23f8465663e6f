"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of

* the text's likelihood: byte trigrams of its words, multinomial with add-one
  counts of all labelled texts, tempered to the weight of ``EVIDENCE`` trigrams
  (trigrams of one text are not independent);
* the likelihood of every language that the markup of its pages declares, and of
  every address suffix, from grouped counts of (value, language), smoothed towards
  the value's own frequency;
* the prior of each host: its language counts are smoothed towards those of its
  parent domain, these towards all documents.  Further hosts count by what their
  prior says beyond that of all documents.

All pages of a document are evidence; a value that several of them share counts
once.  A labelled document's own text and pages are taken out of the counts it is
judged by.  All counts cover all rows; the trigram counts are summed in the tasks
and merged by a grouped sum, and the model (languages x buckets) is all that is
gathered.  Texts are not shuffled: only their log-likelihoods are joined.  Languages are
the places of arrays, so the plan hardly grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.llm.textops import alnum_words, small_batches, written
from canonspark.llm.url_filters import host_of

BUCKETS, EVIDENCE, STRENGTH = 1 << 14, 200, 5.0


def trigram_buckets(text) -> np.ndarray:
    """Bucket of every byte trigram of " word word ... " (empty without words)."""
    words = alnum_words(text)
    if not words:
        return np.empty(0, dtype=np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"]):
            c = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            c += np.bincount(trigram_buckets(text), minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})


def text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the trigram counts of each; the driver holds one row for
    each language and bucket."""
    rows = (labelled.where("lang is not null").select("text", "lang")
            .mapInPandas(_count, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    # a language whose texts hold no trigram has no row of counts, but is one
    langs = sorted({r["lang"] for r in labelled.where("lang is not null").select("lang").distinct().collect()})
    table = np.zeros((len(langs), BUCKETS), dtype=np.int64)
    for i, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        table[i, mine["bucket"].to_numpy(dtype=np.int64)] = mine["n"].to_numpy()
    return langs, table


def _likelihood(langs: list[str], counts: np.ndarray):
    """Log-likelihood of a text in every language, its best at 0; its own trigrams don't count
    for the language it is labelled with."""
    total = counts.sum(axis=1) + BUCKETS
    log_p = np.log(counts + 1.0) - np.log(total)[:, None]
    place = {x: i for i, x in enumerate(langs)}

    def run(texts: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for t, lang in zip(texts, labels):
            b = trigram_buckets(t)
            ll = log_p[:, b].sum(axis=1)
            if lang in place and len(b):
                k = place[lang]
                at, n = np.unique(b, return_counts=True)
                ll[k] = (n * np.log(np.maximum(counts[k, at] - n, 0) + 1.0)).sum() - len(b) * np.log(
                    max(total[k] - len(b), BUCKETS))
            ll = ll * min(1.0, EVIDENCE / max(1, len(b)))
            out.append(ll - ll.max() if len(ll) else ll)
        return pd.Series(out)

    return run


def page_evidence(pages: DataFrame, doc_id: Column) -> DataFrame:
    """``pages(url, html)`` -> ``doc_id, host, declared, suffix, n``: what the pages of a document
    say, and how many of them say the same."""
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1))
    rows = pages.select(doc_id.alias("doc_id"), host.alias("host"), F.when(declared != "", declared).alias("declared"))
    return (rows.where("doc_id is not null").groupBy("doc_id", "host", "declared").agg(F.count(F.lit(1)).alias("n"))
            .select("doc_id", "host", "declared", F.element_at(F.split("host", r"\."), -1).alias("suffix"), "n"))


PARENT = r"([^.]+\.)?[^.]+$"
KEY = ["_ldoc", "_llang", "_lsource"]


def _fused(documents: DataFrame, evidence: DataFrame, langs: list[str]) -> tuple[DataFrame, Column]:
    """What the pages of each ``KEY`` add to the log-posterior, an array over the languages, and
    the most frequent declared language and host; and the log prior of all documents."""
    keys = documents.select(F.col("doc_id").alias("_ldoc"), F.col("lang").cast("string").alias("_llang"),
                            F.col("source").cast("string").alias("_lsource")).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("times"))
    e = evidence.select(F.col("doc_id").alias("_lid"), "host", "declared", "suffix",
                        (F.col("n") if "n" in evidence.columns else F.lit(1)).cast("long").alias("n"))
    joined = keys.join(e, F.col("_ldoc") == F.col("_lid"), "left")
    host = F.coalesce("host", F.when(F.col("_lid").isNull(), F.col("_lsource")))
    said = written(joined.select(*KEY, "times", host.alias("host"), "declared", "suffix", F.coalesce("n", F.lit(1)).alias("n"))
                   .withColumn("parent", F.regexp_extract("host", PARENT, 0)), "said")
    # one row a key and value: ``n`` is what the key itself adds to the value's count
    pieces = said.select(*KEY, "times", "n", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("host", "parent", "declared", "suffix")])).alias("p"))
    pieces = (pieces.where("p.value is not null").groupBy(*KEY, "times", "p.kind", "p.value").agg(F.sum("n").alias("n")))
    pieces = written(pieces, "pieces")
    names = F.array(*[F.lit(x) for x in langs])
    zero = F.expr("cast(map() as map<string, bigint>)")
    counts = (pieces.where("_llang is not null").groupBy("kind", "value", "_llang").agg(F.sum(F.col("n") * F.col("times")).alias("c"))
              .groupBy("kind", "value").agg(F.map_from_entries(F.collect_list(F.struct("_llang", "c"))).alias("m")))
    # documents and pieces of each language; as many rows as languages
    docs = dict(keys.where("_llang is not null").groupBy("_llang").agg(F.sum("times")).collect())
    size = {(r[0], r[1]): r[2] for r in pieces.where("_llang is not null").groupBy("kind", "_llang").agg(
        F.sum(F.col("n") * F.col("times"))).collect()}
    everyone = [(docs.get(x, 0) + 1.0) / (sum(docs.values()) + len(langs)) for x in langs]

    def array(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    own = F.transform(names, lambda x: F.when(x == F.col("_llang"), F.col("n")).otherwise(F.lit(0)))
    raw = F.transform(names, lambda x: F.coalesce(F.element_at(F.coalesce("m", zero), x), F.lit(0)).cast("double"))
    known = (pieces.join(counts, ["kind", "value"], "left")
             .withColumn("c", F.zip_with(raw, own, lambda a, b: F.greatest(a - b, F.lit(0.0))))
             .withColumn("t", F.aggregate("c", F.lit(0.0), lambda a, x: a + x)))

    def likelihood(kind: str) -> DataFrame:
        n = float(sum(v for (k, _), v in size.items() if k == kind) or 1)
        below = array(size.get((kind, x), 0) + STRENGTH for x in langs)
        base = STRENGTH * (F.col("t") + 1.0) / n
        return known.where(F.col("kind") == kind).withColumn("base", base).select(*KEY, F.zip_with(
            "c", below, lambda c, b: F.log((c + F.col("base")) / b)).alias("add"))

    def smoothed(c: str, t: str, prior: Column) -> Column:
        return F.zip_with(c, prior, lambda x, p: (x + STRENGTH * p) / (F.col(t) + STRENGTH))

    hosts = known.where("kind = 'host'").withColumn("parent", F.regexp_extract("value", PARENT, 0))
    parents = known.where("kind = 'parent'").select(*[F.col(k).alias(f"{k}2") for k in KEY], F.col("value").alias("parent"),
                                                    F.col("c").alias("pc"), F.col("t").alias("pt"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in KEY]
    prior = hosts.join(parents.withColumnRenamed("parent", "parent2"),
                       same[0] & same[1] & same[2] & (F.col("parent") == F.col("parent2")))
    prior = prior.withColumn("up", smoothed("pc", "pt", array(everyone))).select(*KEY, F.zip_with(
        smoothed("c", "t", F.col("up")), array(everyone), lambda a, b: F.log(a / b)).alias("add"))
    added = likelihood("declared").unionByName(likelihood("suffix")).unionByName(prior)
    total = added.groupBy(*KEY).agg(F.array(*[F.sum(F.col("add")[i]) for i in range(len(langs))]).alias("_ladd"))

    def most(kind: str) -> Column:
        return F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(
            F.col("kind") == kind, F.struct("n", "value")))

    shown = pieces.groupBy(*KEY).agg(most("declared").alias("_ldeclared"), most("host").alias("_lhost"))
    both = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEY]
    return total.alias("a").join(shown.alias("b"), both[0] & both[1] & both[2], "full").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in KEY], "_ladd", "_ldeclared", "_lhost",
    ), array([np.log(x) for x in everyone])


def identify(documents: DataFrame, evidence: DataFrame, model: tuple[list[str], np.ndarray] | None = None,
             result: str = "language") -> DataFrame:
    """The rows of ``documents(doc_id, text, lang, source, ...)`` with a struct
    ``result``: ``lang`` (most probable), ``prob``, ``text_lang`` (by the text
    alone), ``declared`` and ``host`` (those that most pages give).

    ``evidence(doc_id, host, declared, suffix[, n])``: any number of rows for a document,
    see ``page_evidence``; a document without one has its source for a host and no
    other evidence.  ``lang`` is the label, null where unknown: such rows are
    judged and teach nothing.  A text without words leaves the decision to the
    other evidence; without any label all results are null.  Ties go to the first
    language by name.  Null and repeated doc_ids are judged each; other columns pass
    through, one named like ``result`` is replaced (``_l`` names are reserved);
    empty tables are allowed.
    """
    own = small_batches(documents).drop(result)
    langs, counts = model or text_model(own)
    if not langs:
        return own.withColumn(result, F.expr("named_struct('lang', cast(null as string), 'prob', cast(null as double), "
                                             "'text_lang', cast(null as string), 'declared', cast(null as string), "
                                             "'host', cast(null as string))"))
    ll = F.pandas_udf(_likelihood(langs, counts), "array<double>")
    added, start = _fused(documents, evidence, langs)
    match = (F.col("doc_id").eqNullSafe(F.col("_ldoc")) & F.col("lang").cast("string").eqNullSafe(F.col("_llang"))
             & F.col("source").cast("string").eqNullSafe(F.col("_lsource")))
    rows = own.withColumn("_lll", ll("text", F.col("lang").cast("string"))).join(added, match, "left")
    names = F.array(*[F.lit(x) for x in langs])
    with_prior = F.zip_with("_lll", start, lambda a, b: a + b)
    post = rows.withColumn("_lp", F.when(F.col("_ladd").isNull(), with_prior).otherwise(
        F.zip_with(with_prior, "_ladd", lambda a, b: a + b)))
    top = F.array_max("_lp")
    best = names[(F.array_position("_lp", top) - 1).cast("int")]
    by_text = F.when(F.array_max("_lll") > F.array_min("_lll"),
                     names[(F.array_position("_lll", F.array_max("_lll")) - 1).cast("int")])
    norm = F.aggregate("_lp", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return post.withColumn(result, F.struct(
        best.alias("lang"), (F.lit(1.0) / norm).alias("prob"), by_text.alias("text_lang"),
        F.col("_ldeclared").alias("declared"), F.col("_lhost").alias("host"))).select(*own.columns, result)
