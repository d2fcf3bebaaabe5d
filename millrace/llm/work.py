"""Shared plumbing: the shared work folder, materialised cuts, Arrow batch helpers and skew-safe lookups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..storage import clean, cut, drop_dir, new_dir, qualified, shared_dir

__all__ = ["batched", "clean", "column", "cut", "drop_dir", "filesystem", "fresh", "map_arrow", "map_columns", "new_dir", "only", "qualified", "shared_dir", "skew_lookup", "table", "text_or_empty"]

#: Rows of text that go to a Python worker at once; with the usual few KB a document a batch is a few MB.
ARROW_ROWS = 1000
#: A key is hot when it holds over 1/HOT_KEYS of all rows, so that at most HOT_KEYS keys are hot, and over MIN_HOT rows.
HOT_KEYS = 4096
MIN_HOT = 10_000

def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow filesystem and the path in it; usable in Python workers. Paths come from `new_dir` or `qualified`."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A top-level column by its name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def only(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*map(column, names))


def batched(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of 10,000 long documents would not fit beside others in a worker.

    The setting is the session's; one that differs from Spark's own default is the user's and stays.
    """
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function of one batch."""
    batched(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[[list[pa.Array]], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """mapInArrow over the columns of a batch, for tables with columns of any name: on the way they have plain ones."""
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    names = [f"_{i}" for i in range(len(fields))]
    out = map_arrow(plain, lambda b: pa.RecordBatch.from_arrays(fn(b.columns), names=names), T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)]))
    return out.toDF(*(f.name for f in fields))


def skew_lookup(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """Join left with right, which has one row per key and the number of left rows with it in `count`.

    Keys with over 1/HOT_KEYS of all rows number at most HOT_KEYS: their right rows are broadcast (a proven bound),
    so the rows of a hot key stay where they are. All other keys shuffle, each at most 1/HOT_KEYS of the rows, or MIN_HOT
    rows. Null keys match nothing. `count` is dropped.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    bound = max(MIN_HOT, int(total) // HOT_KEYS)
    hot = right.where(F.col(count) > bound)
    if not hot.head(1):
        return left.join(right.drop(count), key, how)
    keys = [r[0] for r in hot.select(key).collect()]  # at most HOT_KEYS
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    a = left.where(is_hot).join(F.broadcast(hot.drop(count)), key, how)
    b = left.where(~is_hot).join(right.where(F.col(count) <= bound).drop(count), key, how)
    return a.unionByName(b)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
