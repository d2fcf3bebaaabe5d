"""Readers. All are lazy scans by Spark; schemas are explicit, never inferred."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import policy as P
from ..functions import text as X
from ..operators.select import quota_prefix
from ..shipping import ship
from ..storage import cut, qualified
from . import tree

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "source", "category", "language", "repository", "path", "license")])


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines. strict: a bad line fails the read; else it is left out. Blank lines never count."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def required(df: DataFrame, *names: str) -> DataFrame:
    """df, failing on the first row that misses one of the fields."""
    missing = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names or df.columns))
    return df.where(F.when(missing, F.raise_error(F.lit(f"a row misses one of {', '.join(names or df.columns)}"))).otherwise(F.lit(True)).cast("boolean"))


def records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return required(jsonl(spark, path, RECORD, strict)) if strict else jsonl(spark, path, RECORD, strict)


def repository(spark: SparkSession, root: str, source: str, license_name: str, seed: int = 0) -> DataFrame:
    """The classifiable, decodable files of a tree as records with `ord`, their place in the seeded hash order.

    Skipped parts count below the root only. Tasks list the folders, level by level, and read the files: neither names nor
    states of files come to the driver.
    """
    ship(spark)
    root, parts = qualified(spark, root), 4 * spark.sparkContext.defaultParallelism
    level, found = spark.createDataFrame([("", True)], "path string, folder boolean"), []
    while level.where("folder").head(1):
        level = cut(level.where("folder").select("path").repartition(parts, "path").mapInArrow(partial(tree.entries, root), "path string, folder boolean"), "tree-level")
        found.append(level.where("NOT folder").select("path"))
    paths = reduce(DataFrame.unionByName, found) if found else level.select("path")
    raw = paths.where(~P.skipped(F.col("path"))).repartition(parts, "path").mapInArrow(partial(tree.contents, root), "path string, content binary")
    files = raw.where(F.is_valid_utf8("content"))
    cat, lang = P.classify(F.col("path"))
    out = files.select(F.decode("content", "UTF-8").alias("text"), F.lit(source).alias("source"), cat.alias("category"), lang.alias("language"), F.lit(source).alias("repository"), "path", F.lit(license_name).alias("license"))
    return out.where("category IS NOT NULL").withColumn("ord", X.sha(F.concat_ws(":", F.lit(str(seed)), "path")))


def texts(spark: SparkSession, *paths: str, field: str = "text", limit: int | None = None) -> DataFrame:
    """(text) from JSON-line files by field and from other files whole; blank ones dropped, cut at `limit` characters."""
    lines = [p for p in paths if p.endswith(".jsonl")]
    whole = [p for p in paths if not p.endswith(".jsonl")]
    parts = []
    if lines:
        parts.append(spark.read.schema(f"`{field}` string").json(lines).select(F.col(field).alias("text")))
    if whole:
        parts.append(spark.read.text(whole, wholetext=True).select(F.col("value").alias("text")))
    out = reduce(DataFrame.unionByName, parts).where(F.trim(X.squeeze(F.col("text"))) != "")
    return out.withColumn("text", F.substring("text", 1, limit)) if limit else out


def book(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts without what stands before a START marker and from an END marker on."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?is)^.*?\*\*\* ?START OF[^\n]*\n", ""), r"(?is)\*\*\* ?END OF.*$", "")
    return df.withColumn(text, F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")))


def first_text(*columns: str) -> Column:
    """The first of several fields that is filled."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in columns))


def stack(spark: SparkSession, root: str, languages: list[str], schema: str, most: int | None = None, order: str = "ord") -> DataFrame:
    """A partitioned source with a folder per language; the unwanted ones are never listed.

    With `most`, each language stops once its texts so far, in order, have that many bytes; the last one may pass it.
    `origin` and `written` pin a row's revision: its file and when that was written.
    """
    df = with_origin(spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/language={x}" for x in languages)))
    if most is None:
        return df
    sizes = df.select("language", order, F.octet_length("text").cast("long").alias("_bytes"))
    # a row per language: the texts are not shuffled for it
    last = quota_prefix(sizes, "_bytes", "language", F.lit(most), [order]).groupBy("language").agg(F.max(order).alias("_last"))
    return df.join(F.broadcast(last), "language").where(F.col(order) <= F.col("_last")).select(*df.columns)


def with_origin(df: DataFrame) -> DataFrame:
    """A scan with the file that each row comes from and the time it was written."""
    return df.select("*", F.col("_metadata.file_path").alias("origin"), F.col("_metadata.file_modification_time").alias("written"))


def token_bin(spark: SparkSession, path: str) -> DataFrame:
    """(part, ids) of a flat token stream, by the parts that its meta.json names: other files there are of failed tasks."""
    meta = spark.read.json(f"{path}/meta.json").select(F.explode("parts").alias("part"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.element_at(F.split("path", "/"), -1).alias("part"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["part", "ids"])

    return files.join(meta, "part", "left_semi").mapInArrow(run, "part string, ids array<int>")


def generated_transcripts(spark: SparkSession, names: list[str], n: int = 768) -> DataFrame:
    """Synthetic tool transcripts: n per tool name, made from the row's number alone."""
    tools = F.explode(F.array(*map(F.lit, names))).alias("tool")
    r = spark.range(n).select("id", tools)
    args = F.to_json(F.struct((F.col("id") * 37 % 101).alias("x"), (F.col("id") * 53 % 97).alias("y")))
    return r.select("id", "tool", F.concat(F.lit("<|user|>call "), "tool", F.lit(" for item "), F.col("id"), F.lit("<|tool_call|>"), args, F.lit("<|tool_result|>ok<|end|>")).alias("text"))


TEMPLATES = {
    "sum_of": ("Add %d and %d.", "def sum_of():\n    return %d + %d\n"),
    "repeat_word": ("Repeat a word %d times with %d blanks between.", "def repeat_word(w):\n    return (' ' * %2$d).join([w] * %1$d)\n"),
    "in_range": ("Is x between %d and %d?", "def in_range(x):\n    return %d <= x <= %d\n"),
}


def generated_exercises(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Exercises from templates with hash-drawn numbers; row i is the same in every run and at every size."""
    draw = lambda what, n: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{what}"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")
    pick, a, b = draw("t", len(TEMPLATES)), draw("a", 50), draw("b", 50) + 50
    cases = [(F.lit(k), F.format_string(q, a, b), F.format_string(c, a, b)) for k, (q, c) in TEMPLATES.items()]
    rows = F.array(*(F.struct(k.alias("template"), q.alias("prompt"), c.alias("solution")) for k, q, c in cases))
    return spark.range(n).withColumn("r", F.element_at(rows, pick + 1)).select("id", "r.*")
