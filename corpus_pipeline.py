"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linededup, mixing, packing, simhash, toxicity
from millrace.llm.work import cut, fresh, only, table, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half. The model learns from the labelled rows that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    into = fresh(docs, "_score")
    return only(toxicity.score(docs, model, into=into).where(F.col(into) < 0.5), docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go, but for their first occurrence; a document that loses its last word goes too.

    n_chars follows the text. A document without any word from the start stays.
    """
    blank = F.trim(F.regexp_replace(text_or_empty(), r"\s+", " ")) == ""
    was = fresh(docs, "_blank")
    left = linededup.remove_lines(docs.withColumn(was, blank)).where(F.col(was) | ~blank)
    return only(left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document stands in it as many times as it is taken, up to three."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack_words(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learnt model has no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
