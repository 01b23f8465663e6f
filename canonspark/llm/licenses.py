"""Licence scan with a positional rare-token index, in DataFrame functions only.

The templates are a table: a label, the words of a notice, and the key phrase that
must stand in full.  Their postings (word, template, place) are the index.

1. Document frequencies of the key phrases' words are counted over all files.  A
   template is looked up by the word of its key phrase with the highest IDF.
2. A file's places of such words join the postings by word.  A posting and a place
   give the relative position at which the template would begin.
3. There its key phrase is verified word by word; then all words of the template
   are compared at their places (a place carries the words around it, as far as the
   longest template reaches).  A template is found if its share of matching
   words reaches ``least``.  Any place of a key phrase holds its rarest word, so the
   lookup loses none.

Plain phrases are templates that are their own key phrase and count wherever their
words stand consecutively.  Whole texts are not shuffled, only word
counts (one row for each key word) and what was found.  The plan is the same for
any number of templates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonspark.llm.notices import NOTICES, PHRASE_TEXTS
from canonspark.llm.textops import alnum_words, ascii_lower, written


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def key_at(self) -> int:
        k = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + k] == self.key)


def template(label: str, text: str, key: str) -> Template:
    return Template(label, *[tuple(w.decode() for w in alnum_words(t)) for t in (text, key)])


TEMPLATES = tuple(template(*n) for n in NOTICES)
PHRASES = tuple(template(label, text, text) for label, text in PHRASE_TEXTS)
LEAST = 0.8

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def template_table(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``id, label, words, key, key_at, base``; a user's table may stand in its place."""
    rows = [(i, t.label, list(t.words), list(t.key), t.key_at, i >= len(templates))
            for i, t in enumerate([*templates, *phrases])]
    return spark.createDataFrame(rows, "id int, label string, words array<string>, key array<string>, key_at int, base boolean")


def postings(words: DataFrame, templates: DataFrame) -> DataFrame:
    """For every template its posting of the word of its key phrase that the fewest of all
    files hold (ties: the first place): ``word, id, label, words, key, key_at, base, at``."""
    places = templates.select("*", F.posexplode("key").alias("i", "word"))
    vocabulary = [r["word"] for r in places.select("word").distinct().collect()]  # as large as the templates
    df = (words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
          .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    rare = (places.join(df, "word", "left").groupBy("id")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "i", "word")).alias("rare")))
    return templates.join(rare, "id").select("*", F.col("rare.word").alias("word"),
                                             (F.col("key_at") + F.col("rare.i")).alias("at")).drop("rare")


def _matches(words: Column, start: Column, wanted: Column) -> Column:
    """How many of ``wanted`` stand at their place when it begins at ``start``."""
    return F.size(F.filter(F.transform(wanted, lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False))),
                           lambda hit: hit))


def scan(documents: DataFrame, templates: DataFrame | None = None, least: float = LEAST, keep: tuple[str, ...] = ("doc_id",),
         result: str = "licenses") -> DataFrame:
    """One row for each row of ``documents(text, ...)``: the columns ``keep`` and a struct
    ``result``: ``n_words``, ``base`` (label and start of every place of a phrase) and
    ``found`` (label, start and share of every template found; a start below 0 means
    that the template begins before the text).

    Words are alphanumeric words of the lower-cased (A-Z) text, counted from 0; a
    null text is empty and an empty one has no words.  Rows are told apart by their
    place, so nulls and repeated ids or rows are rows of their own.  Other columns take
    no part; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    templates = template_table(spark) if templates is None else templates
    words = words_of(F.col("text").cast("string"))
    # written: a row a template, read by the lookup and by the list of words to look up
    index = written(postings(documents.select(words.alias("words")), templates), "postings")
    looked_up = [r["word"] for r in index.select("word").distinct().collect()]  # one a template at most
    # words that a template may span before and after the word it is looked up by
    reach = index.agg(F.max("at"), F.max(F.size("words") - F.col("at"))).first()
    before, after = (reach[0] or 0), (reach[1] or 1)
    own = documents.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], words.alias("_w")).withColumn(
        "_row", F.monotonically_increasing_id())
    places = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("word"), i.alias("p")))),
                      lambda x: x.isNotNull())
    keys = [f"_k{i}" for i in range(len(keep))]
    # a place carries on the words around it, never the whole text
    low = F.greatest(F.col("_x.p") - before, F.lit(0))
    spots = (own.withColumn("_n", F.size("_w").cast("long")).select("*", F.explode_outer(places).alias("_x"))
             .select("_row", *keys, "_n", "_x", low.alias("_low"),
                     F.slice("_w", low + 1, F.col("_x.p") + after - low).alias("_s")))
    met = spots.join(index, F.col("_x.word") == index["word"], "left")
    start = F.col("_x.p") - F.col("at")
    stands = _matches(F.col("_s"), start + F.col("key_at") - F.col("_low"), F.col("key")) == F.size("key")
    share = _matches(F.col("_s"), start - F.col("_low"), F.col("words")) / F.size("words")
    hit = (met.withColumn("_share", F.when(stands, share))
           .select("_row", *keys, "_n", "base", F.when(F.col("_share").isNotNull() & (F.col("base") | (F.col("_share") >= least)),
                                                       F.struct("label", start.cast("int").alias("start"),
                                                                F.col("_share").alias("share"))).alias("hit")))
    grouped = hit.groupBy("_row", *keys, "_n").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), F.struct("hit.label", "hit.start", F.col("hit").isNotNull().alias("ok"))))).alias("b"),
        F.sort_array(F.collect_list(F.when(~F.col("base"), F.col("hit")))).alias("found"))
    base = F.transform(F.filter("b", lambda x: x["ok"]), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start")))
    return grouped.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
                          F.struct(F.col("_n").alias("n_words"), base.alias("base"), "found").alias(result))


def digest(rows: DataFrame, result: str = "licenses") -> DataFrame:
    """``rows`` of ``scan`` -> doc_id and the figures of one file."""
    r = F.col(result)
    starts = F.transform(r["base"], lambda b: b["start"].cast("long"))
    names = F.transform(r["base"], lambda b: b["label"])
    more = F.transform(r["found"], lambda b: b["label"])

    def listed(c: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(c)))

    share = F.coalesce(F.array_max(F.transform(r["found"], lambda b: b["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", r["n_words"].alias("n_words"), F.size(r["base"]).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(names).alias("base_labels"), listed(F.concat(names, more)).alias("labels"),
        F.when(F.size(r["base"]) > 0, F.lit(1.0)).otherwise(share).alias("score"))
