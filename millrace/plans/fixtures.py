"""The tables as corpus records, in Spark and in SQL.

`documents` has no repository, path, category or license of its own: repository is the source, path is made from the
id, category follows from the id (a stand-in, so that quota queries have several buckets), license is read from a license line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_line(text: Column) -> Column:
    return (
        F.when(text.contains("Apache License, Version 2.0"), "Apache-2.0")
        .when(text.contains("MIT License"), "MIT")
        .when(text.contains("GNU General Public License, version 3"), "GPL-3.0")
        .when(text.contains("CC BY-NC 4.0"), "CC-BY-NC-4.0")
        .otherwise("OWNED")
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        "text",
        "source",
        F.element_at(F.array(F.lit("code"), F.lit("documentation"), F.lit("english")), (F.col("doc_id") % 3 + 1).cast("int")).alias("category"),
        F.col("lang").alias("language"),
        F.col("source").alias("repository"),
        F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        license_line(F.col("text")).alias("license"),
    )


def counted(df: DataFrame) -> DataFrame:
    """With bytes, and tokens by the default pre-tokenizer."""
    return df.withColumns({"bytes": F.octet_length("text").cast("long"), "tokens": T.pretokens(F.col("text"))})


RECORDS = """rec AS (SELECT doc_id AS ord, text, source, ['code', 'documentation', 'english'][doc_id % 3 + 1] AS category, lang AS language,
  source AS repository, 'docs/' || doc_id || '.txt' AS path,
  CASE WHEN contains(text, 'Apache License, Version 2.0') THEN 'Apache-2.0' WHEN contains(text, 'MIT License') THEN 'MIT'
    WHEN contains(text, 'GNU General Public License, version 3') THEN 'GPL-3.0' WHEN contains(text, 'CC BY-NC 4.0') THEN 'CC-BY-NC-4.0' ELSE 'OWNED' END AS license,
  strlen(text)::BIGINT AS bytes, len(regexp_extract_all(text, '[A-Za-z_]+|[0-9]+|[^\\sA-Za-z_0-9]'))::BIGINT AS tokens FROM documents)"""

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def normal_sql(c: str) -> str:
    return f"lower({squeeze_sql(c)})"


def fraction_sql(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def values(spark: SparkSession, sql: str) -> DataFrame:
    """A literal relation that both engines read the same."""
    return spark.sql(sql)
