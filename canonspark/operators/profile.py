"""Column profile and preview.

One unpivot of all columns, one group-by on (column, value), one group-by on
column: two shuffles whatever the number of columns.  Samples are the first
distinct values by first row (top-k, never a collect of a whole column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.functions import text as T
from canonspark.operators.topk import top_k_per_group
from canonspark.operators.reshape import quoted, with_row_id

# Profile thresholds of the reference
NUMERIC_SHARE = 0.8
UNIQUE_SHARE = 0.5
CATEGORICAL_MAX_DISTINCT = 20
SHORT_TEXT_WORDS = 3
MISSING_SHARE = 0.5
SAMPLE_SIZE = 5
PREVIEW_ROWS = 100


def profile_columns(df: DataFrame, row_id: str = "row_id", columns: list[str] | None = None,
                    signed: bool = False) -> DataFrame:
    """``name, type, missingCount, uniqueCount, sampleValues, isShortText, important``
    plus ``col_ord`` (the column position, for ordering)."""
    cols = columns or [c for c in df.columns if c != row_id]
    ordmap = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    long = (df.select(quoted(row_id).alias("_rid"), *[quoted(c).cast("string").alias(c) for c in cols])
            .unpivot(["_rid"], [quoted(c) for c in cols], "name", "raw"))
    v = F.when(T.strip("raw") != "", T.strip("raw"))          # P1: NULL and blank are missing
    per_value = (long.select("name", "_rid", v.alias("v"))
                 .groupBy("name", "v")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("first_row")))
    # the counts and the samples share this shuffle (one plan, one scan of the source)
    kept = F.col("v").isNotNull()
    per_col = per_value.groupBy("name").agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("nonblank"),
        F.count("v").alias("uniqueCount"),
        F.sum(F.when(kept & T.is_numeric_text("v", signed), F.col("n")).otherwise(0)).alias("num_numeric"),
        F.sum(F.when(kept, F.col("n") * T.word_count("v")).otherwise(0)).alias("words"),
    )
    samples = (top_k_per_group(per_value.where(kept), ["name"], [F.col("first_row"), F.col("v")],
                               CATEGORICAL_MAX_DISTINCT, out="_r")
               .groupBy("name")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda s: s["v"])
                    .alias("_samples")))
    # a table without rows still has a profile row for each column
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "name string")
    p = names.join(per_col, "name", "left").join(samples, "name", "left").fillna(
        0, ["total_rows", "nonblank", "uniqueCount", "num_numeric", "words"])
    return _described(p.withColumn("col_ord", ordmap[F.col("name")]))


def _described(p: DataFrame) -> DataFrame:
    """Profile rows from the counts and first values of each column."""
    nonblank = F.col("nonblank")
    pct_numeric = F.when(nonblank > 0, F.col("num_numeric") / nonblank).otherwise(F.lit(0.0))
    pct_unique = F.when(nonblank > 0, F.col("uniqueCount") / nonblank).otherwise(F.lit(0.0))
    col_type = (F.when(pct_numeric > NUMERIC_SHARE, F.lit("numeric"))
                .when((pct_unique < UNIQUE_SHARE) & (F.col("uniqueCount") < CATEGORICAL_MAX_DISTINCT),
                      F.lit("categorical"))
                .otherwise(F.lit("text")))
    missing = F.col("total_rows") - nonblank
    avg_words = F.when(nonblank > 0, F.col("words") / nonblank)
    pct_missing = F.when(F.col("total_rows") > 0, missing / F.col("total_rows")).otherwise(F.lit(1.0))
    samples_all = F.coalesce(F.col("_samples"), F.array().cast("array<string>"))
    return p.select(
        F.col("name"),      # physical name; csv.display_name shows auto-named headers as 
        col_type.alias("type"),
        missing.cast("long").alias("missingCount"),
        F.col("uniqueCount").cast("long").alias("uniqueCount"),
        F.when(col_type == "categorical", samples_all)
         .otherwise(F.slice(samples_all, 1, SAMPLE_SIZE)).alias("sampleValues"),
        F.coalesce((col_type == "text") & (avg_words < SHORT_TEXT_WORDS), F.lit(False)).alias("isShortText"),
        ((col_type == "categorical") & (F.col("uniqueCount") > 1)
         & (F.col("uniqueCount") < CATEGORICAL_MAX_DISTINCT) & (pct_missing < MISSING_SHARE)).alias("important"),
        "col_ord",
    )


SKETCH = "name string, col_ord int, total_rows long, nonblank long, num_numeric long, words long, distinct binary, " \
         "firsts array<struct<part:int,row:bigint,v:string>>"


def sketch_columns(df: DataFrame, part: int, row_id: str = "row_id", columns: list[str] | None = None,
                   lg_k: int = 12) -> DataFrame:
    """A2 opt-in: what a profile needs of one part of a table, one row a column, to be stored
    and combined with other parts by ``merge_sketches`` without reading any part again.
    Counts and the first 20 distinct values (by ``part``, then row) are exact;
    distinct values are a sketch of 2**lg_k registers, whose relative standard error is
    about 0.83 / sqrt(2**lg_k): 1.3 % at 12."""
    cols = columns or [c for c in df.columns if c != row_id]
    ordmap = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    long = (df.select(quoted(row_id).cast("long").alias("_rid"), *[quoted(c).cast("string").alias(c) for c in cols])
            .unpivot(["_rid"], [quoted(c) for c in cols], "name", "raw"))
    v = F.when(T.strip("raw") != "", T.strip("raw"))
    rows = long.select("name", "_rid", v.alias("v"))
    known = F.col("v").isNotNull()
    sums = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("v").alias("nonblank"),
        F.sum(F.when(known & T.is_numeric_text("v"), 1).otherwise(0)).cast("long").alias("num_numeric"),
        F.sum(F.when(known, T.word_count("v")).otherwise(0)).cast("long").alias("words"),
        F.hll_sketch_agg("v", F.lit(lg_k)).alias("distinct"))
    first = rows.where(known).groupBy("name", "v").agg(F.min("_rid").alias("row")).withColumn("part", F.lit(part))
    return sums.join(_firsts(first), "name", "left").select(
        "name", ordmap[F.col("name")].alias("col_ord"), "total_rows", "nonblank", "num_numeric", "words", "distinct",
        F.coalesce("firsts", F.expr("cast(array() as array<struct<part:int,row:bigint,v:string>>)")).alias("firsts"))


def _firsts(values: DataFrame) -> DataFrame:
    """The first distinct values ``(name, v, part, row)`` of every column, as an array."""
    top = top_k_per_group(values.select("name", "part", "row", "v"), ["name"], [F.col("part"), F.col("row"), F.col("v")],
                          CATEGORICAL_MAX_DISTINCT, out="_r")
    return top.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("part", "row", "v"))).alias("firsts"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several parts, as one; in any order, and of merged ones too."""
    sums = sketches.groupBy("name").agg(F.min("col_ord").alias("col_ord"), *[F.sum(c).alias(c) for c in (
        "total_rows", "nonblank", "num_numeric", "words")], F.hll_union_agg("distinct").alias("distinct"))
    first = (sketches.select("name", F.explode("firsts").alias("x")).groupBy("name", F.col("x.v").alias("v"))
             .agg(F.min(F.struct("x.part", "x.row")).alias("at")).select("name", "v", "at.part", "at.row"))
    return sums.join(_firsts(first), "name", "left").withColumn("firsts", F.coalesce(
        "firsts", F.expr("cast(array() as array<struct<part:int,row:bigint,v:string>>)")))


def profile_from_sketch(sketch: DataFrame) -> DataFrame:
    """The profile of a merged sketch.  Fewer than 20 distinct values are counted exactly, so types
    and flags are those of ``profile_columns``; only larger ``uniqueCount`` are estimates."""
    few = F.size("firsts")
    unique = F.when(few < CATEGORICAL_MAX_DISTINCT, few.cast("long")).otherwise(
        F.greatest(F.hll_sketch_estimate("distinct"), F.lit(CATEGORICAL_MAX_DISTINCT).cast("long")))
    return _described(sketch.withColumns({"uniqueCount": unique, "_samples": F.transform("firsts", lambda x: x["v"])}))


def parse_limit(limit) -> int | None:
    """S5: 'all' -> no limit, an integer -> that many rows, anything else 100."""
    if limit == "all":
        return None
    try:
        return int(limit)
    except (TypeError, ValueError):
        return PREVIEW_ROWS


def preview_rows(df: DataFrame, limit="100", row_id: str = "row_id") -> DataFrame:
    """First n rows by row id, NULL as '' and every cell as text."""
    n = parse_limit(limit)
    out = df.orderBy(row_id)
    if n is not None:
        out = out.limit(n)
    return out.select(quoted(row_id), *[T.fill_text(quoted(c)).alias(c) for c in df.columns if c != row_id])


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


# Spellings of each type; a column's type is the join of those of its values
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def _float_text(x: Column) -> Column:
    """A double as its shortest plain text: ``1.0``, ``12345678.5``, ``1e+16``."""
    plain = x.cast("string")
    whole = F.concat(x.cast("decimal(17,0)").cast("string"), F.lit(".0"))
    long = F.regexp_replace(plain.cast("decimal(38,16)").cast("string"), "0+$", "")
    tiny = F.regexp_replace(F.regexp_replace(plain, r"\.0E", "e"), "E", "e")
    two = F.regexp_replace(F.regexp_replace(tiny, r"e([0-9])", "e+$1"), r"e([+-])([0-9])$", "e$10$2")
    size = F.abs(x)
    return (F.when(F.isnan(x), F.lit(None).cast("string")).when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
            .when((size < 1e7) & ((size >= 1e-3) | (size == 0)), plain)
            .when(size >= 1e16, two).when((size >= 1e7) & (x == F.floor(x)), whole).when(size >= 1e-4, long).otherwise(two))


def column_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """``integer``, ``number``, ``boolean`` or ``text`` for every column of text: one pass that
    counts, mergeably, the values of each type.  Missing values fit every type, but a
    column of integers with missing ones is one of numbers; one without values is too."""
    parts = []
    for c in columns:
        v = quoted(c)
        whole = v.rlike(INTEGER) & F.expr(f"try_cast(trim({_sql(c)}) as bigint)").isNotNull()
        for test in (v.isNotNull(), whole, v.rlike(NUMBER), v.isin(*TRUE, *FALSE), F.lit(True)):
            parts.append(F.sum(F.when(test, 1).otherwise(0)))
    got = df.agg(*parts).first() if columns else []
    out = {}
    for i, c in enumerate(columns):
        known, whole, number, boolean, rows = (x or 0 for x in got[5 * i : 5 * i + 5])
        out[c] = ("number" if known == 0 else "integer" if whole == known == rows else "number" if number == known
                  else "boolean" if boolean == known == rows else "text")
    return out


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def merged_spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of text with one spelling for each value of their type: in a column of numbers
    ``1``, ``1.0`` and ``01`` are ``1.0``, in one of integers ``01`` and ``+1`` are ``1``."""
    kinds = column_types(df, columns)
    change = {}
    for c, kind in kinds.items():
        v = F.trim(quoted(c))
        if kind == "integer":
            change[c] = v.cast("bigint").cast("string")
        elif kind == "number":
            word = F.lower(v)
            change[c] = _float_text(F.when(word.rlike("inf"), F.when(word.startswith("-"), float("-inf")).otherwise(
                float("inf"))).otherwise(F.expr(f"try_cast(trim({_sql(c)}) as double)")))
        elif kind == "boolean":
            change[c] = F.when(quoted(c).isin(*TRUE), "True").otherwise("False")
    return df.select(*[change[c].alias(c) if c in change else quoted(c) for c in df.columns])


def analyze_csv(spark, path: str, limit="100", infer: bool = True):
    """S1-S5, A1-A7, A21 together: read a CSV (missing-value tokens to NULL; fields may hold line
    breaks), add a row id, and return ``(profile, preview, shape)``.  With ``infer`` the
    spellings of a number are one value in a column of numbers.  Columns that
    had a blank header are shown as '' in the profile (S2), keeping their unique
    physical name (D8)."""
    from canonspark.sources import csv as CSV

    raw = CSV.read_csv(spark, path)
    cols = list(raw.columns)
    if infer:
        raw = merged_spellings(raw, cols)
    df = with_row_id(raw)
    shown = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(CSV.display_name(c)))])
    prof = profile_columns(df, columns=cols).withColumn("name", shown[F.col("name")])
    return prof, preview_rows(df, limit), table_shape(raw)
