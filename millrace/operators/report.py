"""Metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate of passing with k of n samples of which c are right; NaN for k > n."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1 - F.lit(float(k)) / i))
    return F.when(n < k, F.lit(float("nan"))).when(n - c < k, F.lit(1.0)).otherwise(1 - F.when(c == 0, F.lit(1.0)).otherwise(miss))


def greedy_cover(df: DataFrame, needs: str, steps: int) -> DataFrame:
    """(step, feature, unlocked): each step takes the feature that completes most sets, then the one in most sets; ties by name.

    A job per step, over the sets that still miss something; what comes to the driver is one feature.
    """
    spark, taken, out = df.sparkSession, [], []
    for i in range(steps):
        got = F.array(*map(F.lit, taken)).cast("array<string>")
        left = df.select(F.array_except(needs, got).alias("m")).where(F.size("m") > 0)
        best = left.select(F.explode("m").alias("f"), (F.size("m") == 1).cast("int").alias("one")).groupBy("f").agg(F.sum("one").alias("a"), F.count("*").alias("n")).orderBy(F.desc("a"), F.desc("n"), "f").first()
        if best is None:
            break
        taken.append(best["f"])
        done = df.where((F.size(needs) > 0) & (F.size(F.array_except(needs, F.array(*map(F.lit, taken)))) == 0)).count()
        out.append((i + 1, best["f"], done))
    return spark.createDataFrame(out, "step int, feature string, unlocked int")


def plateau(df: DataFrame, order: str, loss: str, gain: float) -> DataFrame:
    """The best loss so far, and how many rows ago it last fell by more than `gain`. One series; use a partition for many."""
    w = Window.orderBy(order)
    was = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = df.withColumn("_was", was).withColumn("_new", (F.col("_was").isNull() | (F.col(loss) < F.col("_was") - gain)).cast("int"))
    g = b.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stale = (F.row_number().over(Window.partitionBy("_island").orderBy(order)) - 1).cast("long")
    return g.select(order, loss, F.least(F.col(loss), F.coalesce("_was", loss)).alias("best"), stale.alias("stale"))
