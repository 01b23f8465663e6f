"""Parquet sources and the derived fixtures (FIXTURES.md section 3).

The generated tables are clean, so the messy short-text fixture is derived by
one SQL text that both Spark and DuckDB run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed fixture text, run as is by Spark and by the DuckDB oracle
MESSY_PART_SQL = """
SELECT p_partkey AS row_id,
       CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END AS category,
       CASE p_partkey % 7
         WHEN 0 THEN upper(p_name)
         WHEN 1 THEN concat('  ', p_name, '!')
         WHEN 2 THEN concat(substring(p_name, 1, 3), substring(p_name, 5))
         WHEN 3 THEN concat(p_name, 's')
         WHEN 4 THEN CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '  ' END
         ELSE p_name END AS name_a,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS name_b
FROM part
"""

# Entity fixture: each supplier's nation name written the way a person might
MESSY_SUPPLIER_NATION_SQL = """
SELECT s.s_suppkey AS row_id,
       CASE s.s_suppkey % 4
         WHEN 0 THEN lower(n.n_name)
         WHEN 1 THEN replace(n.n_name, '_', ' ')
         WHEN 2 THEN concat('the ', n.n_name)
         ELSE n.n_name END AS nation_text
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

# English word frequencies of the documents: the spelling dictionary
DICTIONARY_SQL = """
SELECT word, count(*) AS freq
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word
      FROM documents WHERE lang = 'en') w
GROUP BY word
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def messy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("part",))
    return spark.sql(MESSY_PART_SQL)


def messy_supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("supplier", "nation"))
    return spark.sql(MESSY_SUPPLIER_NATION_SQL)


def dictionary(spark: SparkSession, sf_dir: str, lang: str = "en") -> DataFrame:
    """``word, freq`` from the documents of one language (all of them)."""
    docs = load(spark, sf_dir, "documents").where(F.col("lang") == lang)
    return (docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write original plus cleaned rows (parquet, csv with header, or json)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = (w.option("header", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.format(fmt).save(path)
