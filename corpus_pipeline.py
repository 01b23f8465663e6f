"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark
contamination, mixing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame.  It works on all
rows of its predecessor, its decisions take effect, and all but the last return
the columns of documents; the last one adds the copy's number.  Each result is
written as Parquet and read again, so a stage's lineage ends at its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canonspark.llm import decontaminate, mixing, near_dedup, quality, suffix_dedup
from canonspark.llm.queries import page_doc_id
from canonspark.llm.textops import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = 51  # words; a passage of over 50 words that repeats leaves, whatever its bytes


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.  Null and empty texts are judged by
    shape and metadata, rows that repeat an id each for itself; without labels
    all stay, an empty table stays empty."""
    pages = written(quality.page_metadata(read_table(spark, sf_dir, "pages"), page_doc_id(F.col("url"))), "pages")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), pages)
    return quality.judge(docs, model, pages).where("quality_score.kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays,
    once.  Rows without an id stay; an id that names several texts goes only if
    none of them stays.  Texts without words are near nothing and stay."""
    judged = near_dedup.near_duplicates(docs)
    gone = written(judged.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
                   .where("not kept").select("doc_id"), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source"))
    known = left.where("doc_id is not null").withColumn("again", again).where("again = 1").select(*COLUMNS)
    return known.unionByName(left.where("doc_id is null"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages (``PASSAGE`` words, or op10's 400 bytes) leave the texts; a document of which nothing is left goes.  A
    cut may split a character: what is left of it goes too (in texts that are cut,
    replacement characters go with it)."""
    r = suffix_dedup.remove_repeats(docs.select(*COLUMNS), words=PASSAGE)
    valid = F.make_valid_utf8(F.col("repeats.kept").cast("string"))
    text = F.when(F.col("repeats.n_removed") > 0, F.replace(valid, F.lit("\ufffd"), F.lit(""))).otherwise(F.col("text"))
    length = F.when(F.col("repeats.n_removed") > 0, F.char_length("cut")).otherwise(F.col("n_chars"))
    return (r.withColumn("cut", text).where("repeats.n_removed = 0 or cut != ''")
            .select("doc_id", F.col("cut").alias("text"), "lang", "source", length.cast("long").alias("n_chars")))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.  Null and empty texts stay, repeated rows are judged
    alike; without a benchmark all stay."""
    r = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return r.where("not benchmark_hits.contaminated").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes of a document (none to three).  Null and
    empty texts have size 0, a null source is a source; rows that agree in id, source
    and size share their copies, dealt out by a hash; an empty table stays empty."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    r = mixing.mix(sized).where("mix.copies > 0")
    return r.select(*COLUMNS, "size", "mix.target", "mix.source_size",
                    F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the classifier and the rounding; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
