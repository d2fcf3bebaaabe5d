"""Quotas, caps, interleaving and other selections over an explicit total order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Slices of a total order that are summed on their own.
SLICES = 1024


def slice_of(df: DataFrame, first: str) -> Column:
    """The slice of a row by its first order column: of a hash (hexadecimal) its head, of a number its share of the range.

    A slice holds a stretch of the order, so running totals need the slices' totals and each slice's own rows only.
    """
    if dict(df.dtypes)[first] == "string":
        return F.conv(F.substring(first, 1, 3), 16, 10).cast("int")
    lo, hi = df.agg(F.min(first), F.max(first)).first()
    if lo is None or lo == hi:
        return F.lit(0)
    return F.least(F.lit(SLICES - 1), F.floor((F.col(first) - F.lit(lo)) / F.lit(float(hi - lo)) * SLICES)).cast("int")


def with_before(df: DataFrame, amount: Column, order: list[str], by: list[str] | None = None, into: str = "_before") -> DataFrame:
    """df with the total of `amount` over the rows before each, per `by`, at any size and skew.

    One window over all rows, or over a hot group, would be one task. Here slices of the order are totalled with map-side
    combination, a window over at most a few thousand slice totals per group gives each slice's start, and the rows of a
    slice are summed by the task that has it. df is read three times, so it is written first: it should be narrow.
    """
    by = by or []
    df = cut(df.withColumn("_amount", amount), "running")
    sliced = df.withColumn("_slice", slice_of(df, order[0]))
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("_amount").alias("_t"))
    start = F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*by, "_slice", start.alias("_start"))
    w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(starts, [*by, "_slice"]).withColumn(into, F.col("_start") + F.coalesce(F.sum("_amount").over(w), F.lit(0))).drop("_slice", "_amount", "_start")


def with_rank(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with the place of each row in a total order, from 1."""
    return with_before(df, F.lit(1), order, into=into).withColumn(into, (F.col(into) + 1).cast("long"))


def quota_prefix(df: DataFrame, amount: str, bucket: str | None, target: Column, order: list[str]) -> DataFrame:
    """Rows while their bucket's total before them is under the target, so it may be passed by one row."""
    return with_before(df, F.col(amount), order, [bucket] if bucket else None).where(F.col("_before") < target).drop("_before")


def top_per(df: DataFrame, by: str, n: int, order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def interleave(df: DataFrame, amount: str, source: str, weight: str, order: list[str], into: str = "at") -> DataFrame:
    """df with its place in a mix that always takes from the source with the least emitted amount per weight."""
    return with_before(df, F.greatest(F.lit(1), F.col(amount)), order, [source], into).withColumn(into, F.col(into) / F.col(weight))


def largest_remainder(shares: DataFrame, total: int, share: str = "share", rank: str = "rank") -> DataFrame:
    """An integer allocation of a total: floors first, then one each by the largest remainder, ties by rank."""
    exact = F.col(share) * F.lit(total)
    base = shares.withColumns({"_floor": F.floor(exact).cast("long"), "_rest": exact - F.floor(exact)})
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), rank))
    return base.withColumns({"_left": left, "_place": place}).withColumn("allocated", F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).drop("_floor", "_rest", "_left", "_place")


def balanced(allocated: DataFrame, rank: str = "rank") -> DataFrame:
    """An allocation in which nothing gets nothing: one each from the largest donor, ties by rank. A row a share."""
    none = F.count_if(F.col("allocated") == 0).over(Window.partitionBy())
    donor = F.row_number().over(Window.orderBy(F.desc("allocated"), rank)) == 1
    return allocated.withColumn("allocated", F.when(F.col("allocated") == 0, 1).otherwise(F.col("allocated") - F.when(donor, none).otherwise(0)).cast("long"))


def ordered_fold(df: DataFrame, order: list[str], step: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """A fold over narrow rows in order, with one state: for selections whose caps, quotas and dedup interact.

    The reference semantics are sequential; callers pass ids, sizes and hashes only, never texts, and rows that a
    row-local rule rejects are gone before. step gets a batch and the state, and returns the batch's decisions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for b in batches:
            yield step(b, state)

    return df.repartition(1).sortWithinPartitions(*order).mapInPandas(run, schema)


def keyed_fold(df: DataFrame, key: str, order: list[str], step: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """Like ordered_fold with a state per key: keys are spread over partitions, one pass each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for b in batches:
            yield step(b, states)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def next_fit(df: DataFrame, by: str, order: str, length: str, limit: int) -> DataFrame:
    """(by, order, row): next-fit rows per group; a row ends when the next length no longer fits. The state is one number a group.

    Rows arrive sorted and leave batch by batch, so a group of any size needs no more memory than a batch.
    """

    def step(b: pd.DataFrame, s: dict) -> pd.DataFrame:
        rows = []
        for group, n in zip(b[by], b[length]):
            row, used = s.get(group, (0, 0))
            row, used = (row + 1, n) if used and used + n > limit else (row, used + n)
            s[group] = row, used
            rows.append(row)
        return pd.DataFrame({by: b[by], order: b[order], "row": rows})

    kinds = dict(df.dtypes)
    return keyed_fold(df.select(by, order, length), by, [order], step, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, row long")
