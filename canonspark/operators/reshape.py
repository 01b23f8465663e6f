"""Long form of the short-text columns and its inverse.

``long`` schema: ``group_key, row_id, col_name, col_ord, value, norm, occ``
where ``occ = struct(col_ord, row_id)`` is the occurrence order (W3): in
category mode all rows of the first column come before the next column (melt
order), in direct mode each column is its own group and rows keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from canonspark.functions import text as T


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_id(df: DataFrame, key: str | None = None, name: str = "row_id") -> DataFrame:
    """Use the caller's key as row id, else a unique increasing id."""
    if key is not None:
        return df.withColumn(name, F.col(key).cast("long")) if key != name else df
    return df.withColumn(name, F.monotonically_increasing_id())


def check_row_ids(df: DataFrame, row_id: str) -> None:
    """Occurrences are told apart by ``row_id``, so it must be unique and not
    null; one aggregation that stops at the first repeated id."""
    ids = df.groupBy(quoted(row_id)).agg(F.count(F.lit(1)).alias("_n"))
    bad = ids.where((F.col("_n") > 1) | quoted(row_id).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{row_id} must be unique and not null; {bad[0][0]!r} stands on {bad[0]['_n']} rows")


def present_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The selected columns that exist, in the given order."""
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def long_text_columns(df: DataFrame, min_avg_len: float = 50.0) -> list[str]:
    """Text columns whose mean length over non-null values exceeds 50 (one job)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not cols:
        return []
    row = df.agg(*[F.avg(F.length(quoted(c).cast("string"))) for c in cols]).first()
    return [c for c, mean in zip(cols, row) if mean is not None and mean > min_avg_len]


def short_text_columns(df: DataFrame, selected: list[str]) -> list[str]:
    """P5: selected minus numeric minus long text."""
    num = set(numeric_columns(df))
    longc = set(long_text_columns(df))
    return [c for c in selected if c in df.columns and c not in num and c not in longc]


def melt(raw: DataFrame, columns: list[str], category: str | None = None,
         row_id: str = "row_id") -> DataFrame:
    """One row per (row, short-text column); NULL values dropped.

    ``group_key`` is the category value in category mode and the column name
    in direct mode.  Category values are kept as they are (NULL stays NULL).
    """
    cols = present_columns(raw, columns)
    if not cols:
        raise ValueError("none of the selected columns is present")
    if category is not None and category in cols:
        raise ValueError("the category column cannot be one of the cleaned columns")  # D21
    if category is not None and category not in raw.columns:
        raise ValueError(f"no column named {category!r} to take the categories from")
    ids = [row_id] + ([category] if category else [])
    base = raw.select(*[quoted(c) for c in ids], *[quoted(c).cast("string").alias(c) for c in cols])
    long = base.unpivot([quoted(c) for c in ids], [quoted(c) for c in cols], "col_name", "value")
    ordmap = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    long = long.withColumn("col_ord", ordmap[F.col("col_name")].cast("int"))
    gk = quoted(category).cast("string") if category else F.col("col_name")
    return (long.where(F.col("value").isNotNull())
            .select(gk.alias("group_key"), quoted(row_id).cast("long").alias("row_id"),
                    "col_name", "col_ord", "value"))


def normalise_long(long: DataFrame, mode: str) -> DataFrame:
    """N1 + P8a/P8b: add ``norm`` and ``occ``; category mode keeps values that
    normalise to '' but drops NULL categories (D12), direct mode drops blanks."""
    out = long.withColumn("norm", T.normalize("value")) \
              .withColumn("occ", F.struct("col_ord", "row_id"))
    if mode == "category":
        return out.where(F.col("group_key").isNotNull())
    if mode == "direct":
        return out.where(T.strip("norm") != "")
    raise ValueError(f"mode must be 'category' or 'direct', not {mode!r}")


def raw_values(long: DataFrame) -> DataFrame:
    """Distinct raw values per group with count, first occurrence and ``norm``:
    normalisation then runs once per distinct value, not once per cell."""
    return (long.groupBy("group_key", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("col_ord", "row_id")).alias("occ"))
            .withColumn("norm", T.normalize("value")))


def keep_for_clustering(mode: str):
    """P8a / P8b on a table with ``group_key`` and ``norm``."""
    if mode == "category":
        return F.col("group_key").isNotNull()
    if mode == "direct":
        return T.strip("norm") != ""
    raise ValueError(f"mode must be 'category' or 'direct', not {mode!r}")


def nodes_from_values(values: DataFrame, mode: str) -> DataFrame:
    """Distinct normalised values per group (same as ``distinct_values``)."""
    return (values.where(keep_for_clustering(mode)).groupBy("group_key", "norm")
            .agg(F.min("occ").alias("occ"), F.sum("n").alias("n")))


def distinct_values(norm_long: DataFrame) -> DataFrame:
    """Distinct normalised values per group with first occurrence and count."""
    return norm_long.groupBy("group_key", "norm").agg(
        F.min("occ").alias("occ"), F.count(F.lit(1)).alias("n"))


def pivot_back(long_cleaned: DataFrame, columns: list[str], value_col: str = "cleaned") -> DataFrame:
    """R2: wide table ``row_id, <col>...`` from the long cleaned values."""
    return (long_cleaned.groupBy("row_id").pivot("col_name", columns)
            .agg(F.first(value_col)))


def attach_cleaned(raw: DataFrame, wide: DataFrame, columns: list[str],
                   row_id: str = "row_id") -> DataFrame:
    """J4 + P12: join cleaned columns on row id and place ``<col>_cleaned``
    right after ``<col>``.  Every non-null cell is in the long table, so a
    cell missing there was NULL and stays NULL (D4: aligned by row id)."""
    renamed = wide.select(F.col("row_id").alias("_rid"),
                          *[quoted(c).alias(f"__{c}__c") for c in columns])
    j = raw.join(renamed, raw[row_id] == renamed["_rid"], "left")
    out = []
    for c in raw.columns:
        out.append(quoted(c))
        if c in columns:
            out.append(F.col(f"__{c}__c").alias(f"{c}_cleaned"))
    return j.select(*out)
