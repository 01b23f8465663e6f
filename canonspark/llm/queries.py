"""Registered queries of this subpackage and the DuckDB statements that
restate them.  Each query reads whole tables and returns the operator's full
result; the operators keep their own general interfaces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonspark.llm import (
    decontaminate, language_id, licenses, lm_scoring, merkle, mixing, near_dedup, phrases, quality, suffix_dedup, topk_search, url_filters,
    warc,
)
from canonspark.llm.oracles import ORACLES as ORACLES  # noqa: PLC0414
from canonspark.llm.textops import ascii_lower, read_table, written
from canonspark.session import ensure_checkpoint_dir


def page_doc_id(url: Column) -> Column:
    """The document a page shows: the number that ends its path."""
    number = F.regexp_extract(url, r"^[a-z]+://[^/?#]*/[^?#]*?([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1)
    return F.when(F.length(number).between(1, 18), number).cast("long")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pages = written(quality.page_metadata(read_table(spark, sf_dir, "pages"), page_doc_id(F.col("url"))), "pages")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), pages)
    r = quality.judge(docs, model, pages, keep_text=False)
    return r.select("doc_id", "quality_score.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, threshold=80)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries that the hosts of the pages give: a few lists whose days follow
    from the host's name (the tables hold no lists of their own)."""
    h = F.col("host")
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    k = F.length(h) * 7 + F.ascii(F.substring(h, -9, 1)) * 3
    rows = F.array(
        *[F.struct(F.lit(name).alias("list"), F.when(use, pattern).alias("pattern"),
                   (k * step % 300 + shift).cast("int").alias("n"), F.lit(action).alias("action"))
          for name, use, pattern, step, shift, action in (
              ("spam", h.rlike("spam|pills|casino"), h, 1, 0, "add"),
              ("spam", h.rlike("spam|pills|casino"), h, 1, 90, "remove"),
              ("spam", h.rlike("spam|pills|casino"), h, 1, 150, "add"),
              ("language", F.length(h) % 2 == 0, F.concat(h, F.lit("/de")), 3, 0, "add"),
              ("language", F.length(h) % 4 == 0, F.concat(h, F.lit("/de")), 3, 60, "remove"),
              ("domain", h.rlike("[.]org$"), F.lit("example.org"), 0, 40, "add"),
              ("domain", h.rlike("[.]org$"), F.lit("example.org"), 0, 45, "remove"),
              ("domain", h.rlike("^blog[.]"), F.regexp_replace(h, "^blog[.]", ""), 5, 10, "add"))])
    e = hosts.select(F.explode(rows).alias("e")).select("e.*").where("pattern is not null").distinct()
    return e.select("list", "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day"), "action")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are fetched on day page_id % 366 of 2024."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    r = url_filters.judge(pages.withColumn("fetched", day), list_entries(pages))
    f = F.col("url_filter")
    return r.select("page_id", "fetched", f["host"].alias("host"), F.concat_ws(",", f["lists"]).alias("lists"),
                    F.concat_ws(",", f["patterns"]).alias("patterns"), f["blocked"].alias("blocked"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk_search.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(v, v.where("vec_id % 100 = 0"), 10)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sizes).select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken", "mix.copies")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    read_table(spark, sf_dir, "benchmark"))
    h = F.col("benchmark_hits")
    return r.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"),
                    F.size(h["items"]).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", h["items"]), 256).alias("items_sha256"),
                    h["contaminated"].alias("contaminated"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # written first, so that the markup is read in a job of its own
    evidence = written(language_id.page_evidence(read_table(spark, sf_dir, "pages"), page_doc_id(F.col("url"))),
                       "evidence")
    r = language_id.identify(docs, evidence)
    return r.select("doc_id", "language.lang", F.round("language.prob", 6).alias("prob"), "language.text_lang",
                    "language.declared", "language.host")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    r = suffix_dedup.remove_repeats(docs)
    return r.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans",
                    F.sha2("repeats.kept", 256).alias("kept_sha256"),
                    F.make_valid_utf8(F.col("repeats.kept").cast("string")).alias("kept_text"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an archive, deduplicated, and what the new archive holds."""
    base = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(read_table(spark, sf_dir, "pages"), f"{base}/captured")
    warc.deduplicate(spark, f"{base}/captured", f"{base}/deduplicated")
    # written first, so that the archive is read once
    heads = written(warc.headers(warc.records(spark, f"{base}/deduplicated"), verify=True), "headers")
    return warc.resolved(heads)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows is checked with a text whose A-Z were lower-cased."""
    docs = read_table(spark, sf_dir, "documents")
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    text = F.when(changed, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    claim = merkle.row_hash([text if f == "text" else F.col(f) for f in merkle.FIELDS])
    return merkle.verify(merkle.build(docs, claim=claim)).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root",
        "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_url_filters": op4_url_filters,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_licenses": op8_licenses,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrases": op11_phrases,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}
