"""Resumable collection, rate limiting and plateau counting as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def collect(stream: DataFrame, out: str, checkpoint: str, budget: int | None = None, mismatches: str | None = None) -> None:
    """Append new texts (each content id once, over all runs) to out until the tokens written reach the budget.

    The offsets and the seen ids live in the checkpoint, so a restart continues where it stopped. With `mismatches`,
    rows that fail the size rule go to that second sink from the same batch. The budget is read from what has been
    written, so it holds over restarts too; the last batch may pass it.
    """
    spark = stream.sparkSession
    rows = stream.withColumns({"id": F.substring(T.sha(F.col("text")), 1, 16), "tokens": T.pretokens(F.col("text"))})

    def written() -> int:
        try:
            return spark.read.parquet(out).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return 0
            raise

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.count()  # every partition, so that the seen ids are kept even past the budget
        if budget is None or written() < budget:
            good = F.col("tokens") >= 12
            batch.where(good).write.mode("append").parquet(out)
            if mismatches:
                batch.where(~good).write.mode("append").parquet(mismatches)
        batch.unpersist()

    q = rows.dropDuplicates(["id"]).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def rate_limited(events: DataFrame, key: str, ts: str, burst: float = 4.0, per_minute: float = 40.0) -> DataFrame:
    """(key, ts, allowed): a token bucket per key over event time; the state is one pair of numbers per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        ok = []
        for t in rows["ts"]:
            now = t.timestamp()
            if last is not None:
                level = min(burst, level + max(0.0, now - last) * per_minute / 60)
            last = now if last is None else max(last, now)
            ok.append(level >= 1)
            level -= level >= 1
        state.update((float(level), float(last)))
        yield pd.DataFrame({"key": k[0], "ts": rows["ts"], "allowed": ok})

    kind = events.schema[key].dataType.simpleString()
    return events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def plateau_stream(losses: DataFrame, gain: float) -> DataFrame:
    """(run, step, best, stale) of a stream of (run, step, loss): evaluations since the last gain, per run."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, stale = state.get if state.exists else (float("inf"), 0)
        rows, out = pd.concat(list(batches)).sort_values("step"), []
        for s, x in zip(rows["step"], rows["loss"]):
            stale = 0 if x < best - gain else stale + 1
            best = min(best, x)
            out.append((k[0], s, best, stale))
        state.update((float(best), int(stale)))
        yield pd.DataFrame(out, columns=["run", "step", "best", "stale"])

    return losses.groupBy("run").applyInPandasWithState(step, "run string, step long, best double, stale long", "best double, stale long", "append", GroupStateTimeout.NoTimeout)
