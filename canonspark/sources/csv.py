"""CSV and record ingest with the usual missing-value tokens.

Every column is read as text (no inference); the tokens below become NULL.  The
header row is read by itself, so that blank headers get a name of their own
(``Unnamed: <i>``, shown as '' in the profile) and repeated ones a number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from canonspark.operators.reshape import quoted
from canonspark.session import ensure_checkpoint_dir

# Field texts read as missing (the common CSV reader default set)
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Fixed value: how a column without a header is called
BLANK_HEADER = "Unnamed"


def header_names(fields: list[str | None]) -> list[str]:
    """Column names of a header row: blank ones ``Unnamed: <i>``, repeated ones with
    a running number."""
    seen: dict[str, int] = {}
    out = []
    for i, f in enumerate(fields):
        name = f if f else f"{BLANK_HEADER}: {i}"
        while name in seen:
            seen[name] += 1
            name = f"{f}.{seen[name]}"
        seen[name] = 0
        out.append(name)
    return out


def _as_missing(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(quoted(c).isin(*NA_TOKENS), F.lit(None).cast("string"))
                       .otherwise(quoted(c)).alias(c) for c in df.columns])


# One field of a line, its quotes closed; and the end of a field whose quote an earlier
# line opened.  A quote inside an unquoted field is a character like any other.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"(?!")[^,]*|[^",][^,]*|)'
_CLOSED = re.compile(rf"{_FIELD}(?:,{_FIELD})*", re.DOTALL)
_CLOSES = re.compile(rf'[^"]*(?:""[^"]*)*"(?!")[^,]*(?:,{_FIELD})*', re.DOTALL)
_OPTIONS = {"escape": '"', "multiLine": "true"}


def _ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line, given whether one was before it."""
    if '"' not in line:
        return inside
    return (_CLOSES if inside else _CLOSED).fullmatch(line) is None


def _split_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a file split's lines make of both states, one row a split."""
    key, after, plain = None, [False, True], True
    for pdf in batches:
        for file, start, line in zip(pdf["file"], pdf["start"], pdf["value"]):
            if (file, start) != key:
                if key is not None:
                    yield pd.DataFrame([(*key, *after, plain)], columns=_STATE_COLUMNS)
                key, after, plain = (file, start), [False, True], True
            ends = [_ends_inside(line, False), _ends_inside(line, True)]
            after = [ends[after[0]], ends[after[1]]]
            plain = plain and not ends[0]
    if key is not None:
        yield pd.DataFrame([(*key, *after, plain)], columns=_STATE_COLUMNS)


_STATE_COLUMNS = ["file", "start", "from_outside", "from_inside", "plain"]
_STATE_SCHEMA = "file string, start long, from_outside boolean, from_inside boolean, plain boolean"
WHOLE, HEAD, TAIL, MIDDLE = range(4)  # a record, and the parts of one that crosses splits


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of each split put together to records."""
    key, inside, held, kind, opened, first = None, False, [], WHOLE, 0, False
    for pdf in batches:
        out = []
        for file, start, at, state, line in zip(pdf["file"], pdf["start"], pdf["at"], pdf["inside"], pdf["value"]):
            if (file, start) != key:
                if inside:
                    out.append((*key, opened, MIDDLE if kind == HEAD else TAIL, first, "\n".join(held)))
                key, inside, held, kind, opened, first = (file, start), bool(state), [], HEAD if state else WHOLE, at, start == 0
            if not inside:
                kind, opened, held = WHOLE, at, []
            held.append(line)
            inside = _ends_inside(line, inside)
            if not inside:
                out.append((file, start, opened, kind, first, "\n".join(held)))
                first = False
        yield pd.DataFrame(out, columns=["file", "start", "at", "kind", "first", "text"])
    if inside:
        yield pd.DataFrame([(*key, opened, MIDDLE if kind == HEAD else TAIL, first, "\n".join(held))],
                           columns=["file", "start", "at", "kind", "first", "text"])


def _whole_records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The text of every record but a file's first.  ``states`` has one row a split: two
    flags carried along a file tell in which state each split begins."""
    w = Window.partitionBy("file").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")   # ends in one state whatever it began in
    turns = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int"))
    known = states.withColumn("turned", turns.over(w)).withColumn(
        "last", F.last(F.when(fixed, F.struct("from_outside", "turned")), ignorenulls=True).over(before))
    since = F.coalesce(turns.over(before), F.lit(0)) - F.coalesce(F.col("last.turned"), F.lit(0))
    inside = F.coalesce(F.col("last.from_outside"), F.lit(False)) != (since % 2 == 1)
    begun = known.select("file", "start", inside.alias("inside"))
    # splits are small in number; where Spark doesn't broadcast them, the sort restores the order of lines
    placed = lines.join(begun, ["file", "start"]).sortWithinPartitions("file", "start", "at")
    parts = placed.mapInPandas(_records, "file string, start long, at long, kind int, first boolean, text string")
    whole = parts.where(F.col("kind") == WHOLE)
    # at most two parts a split
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("start", "at"))
    crossing = (parts.where(F.col("kind") != WHOLE).withColumn("record", number).groupBy("file", "record")
                .agg(F.max("first").alias("first"),
                     F.array_join(F.sort_array(F.collect_list(F.struct("start", "at", "text")))["text"], "\n").alias("text")))
    return whole.select("first", "text").unionByName(crossing.select("first", "text")).where("not first").select("text")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file, or a folder of them, each with a header row; quoted fields may hold line
    breaks.  Files are read by many tasks: one pass over the lines that hold quotes tells
    for every split whether it begins inside a quoted field.  Where no field holds a
    line break Spark's own reader does the rest; else the lines are put together to
    records, also across splits."""
    reader = spark.read.option("escape", '"')
    if columns is None:
        first = reader.option("header", False).option("multiLine", True).csv(path).first()
        columns = header_names(list(first)) if first else []
    if not columns:
        return spark.createDataFrame([], StructType([]))
    schema = StructType([StructField(c, StringType()) for c in columns])
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    ensure_checkpoint_dir(spark)
    quotes = lines.where(F.contains("value", F.lit('"'))).mapInPandas(_split_states, _STATE_SCHEMA).checkpoint(eager=True)
    if quotes.where("not plain").isEmpty():
        return _as_missing(reader.option("multiLine", False).option("header", True).schema(schema).csv(path))
    splits = lines.select("file", "start").distinct().join(quotes, ["file", "start"], "left").fillna(
        {"from_outside": False, "from_inside": True})
    plain = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
    text = F.regexp_replace("text", "\\r$", "")
    parsed = (_whole_records(lines, splits).where(F.trim("text") != "")
              .select(F.from_csv(text, plain.simpleString()[7:-1].replace(":", " "), _OPTIONS).alias("r")))
    return _as_missing(parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]))


def display_name(name: str) -> str:
    """Columns without a header are shown as ''."""
    return "" if name.startswith(BLANK_HEADER) else name


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3: JSON records, one a line, with an explicit schema."""
    return spark.read.schema(schema).json(path)


def read_column_lists(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3: JSON objects of column lists (``{"a": [..], "b": [..]}``, one a line), as
    rows of ``schema``.  Lists of different lengths are filled up with NULL."""
    lists = StructType([StructField(f.name, ArrayType(f.dataType)) for f in schema.fields])
    df = spark.read.schema(lists).json(path)
    rows = df.select(F.explode(F.arrays_zip(*[quoted(f.name).alias(f.name) for f in schema.fields])).alias("r"))
    return rows.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields])
