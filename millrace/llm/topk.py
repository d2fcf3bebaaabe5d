"""Exact top-k search: tiled matrix products of queries and shards, a partial selection per tile, a tree merge.

Components become floor(256 * x), two bytes each where all of a vector fit (else four, or eight), and a vector travels
as these bytes. Queries form tiles and candidates form shards; the cell (tile, shard) multiplies the one by the other in
strips and keeps each query's k best, so a task holds one tile, one shard and one strip of products, whatever the size
of the table. A query's lists from all shards merge FAN at a time until one is left. Tile and shard of a row follow from
a hash of its id and components, so equal and clustered ids spread evenly and reruns agree.

Large tiles keep the shuffle down: a candidate is sent once a tile of TILE queries, a query once a shard of SHARD_BYTES.

A product is exact: in float64 while no partial sum can reach 2**53, else in Python integers, clipped to 64 bits.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors of different lengths
aren't compared; a query meets every row but its own, so rows that repeat its id or all of it are candidates, and
each of several query rows of one id has its own list; ids that are null take no part; ties go to the smaller id, and
rows with the same id and score fill as many ranks as there are; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import batched, column, cut, map_arrow, table

#: Queries in a tile, bytes of vectors in a shard.
TILE = 16_384
SHARD_BYTES = 16 << 20
#: Queries and candidates multiplied at once inside a cell.
ROWS = 1024
STRIP = 4096
FAN = 64
NONE = np.iinfo(np.int64).min


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to the smaller id, with their ids and places; unused places score NONE.

    ids and rows are one row each per query, or shared by all. Only scores of at least `floor` can count.
    """
    n, m = scores.shape
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(n, NONE)
    if floor is not None:
        least = np.maximum(least, floor)
    r, c = np.nonzero(scores >= np.maximum(least, NONE + 1)[:, None])
    s = scores[r, c]
    i, at = (ids[c], rows[c]) if ids.ndim == 1 else (ids[r, c], rows[r, c])
    order = np.lexsort((at, i, -s, r))
    r, s, i, at = r[order], s[order], i[order], at[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    r, rank = r[keep], rank[keep]
    out = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    for o, x in zip(out, (s, i, at)):
        o[r, rank] = x[keep]
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral float64 rows."""
    if q.size and c.size and q.shape[1] * np.abs(q).max() * np.abs(c).max() >= 2.0**53:
        big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
        return np.clip(big, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)
    return (q @ c.T).astype(np.int64)


def cell_top(qrow: np.ndarray, q: np.ndarray, cid: np.ndarray, crow: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best candidates but its own row; unused places score NONE."""
    out_s, out_i = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)
    for a in range(0, len(q), ROWS):
        mine, part = qrow[a : a + ROWS], q[a : a + ROWS]
        s, i, w = (np.full((len(part), k), x) for x in (NONE, np.int64(0), np.int64(0)))
        for at in range(0, len(c), STRIP):
            rows = crow[at : at + STRIP]
            got = _products(part, c[at : at + STRIP])
            place = np.searchsorted(rows, mine)  # candidates come in order of row
            own = np.flatnonzero((place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == mine))
            got[own, place[own]] = NONE
            ts, ti, tw = _best(got, cid[at : at + STRIP], rows, k, s[:, -1])
            s, i, w = _best(np.concatenate([s, ts], axis=1), np.concatenate([i, ti], axis=1), np.concatenate([w, tw], axis=1), k)
        out_s[a : a + ROWS], out_i[a : a + ROWS] = s, i
    return out_s, out_i


def _packed(v: np.ndarray) -> bytes:
    """Integral components in the fewest bytes of 2, 4 and 8, told by the first byte."""
    most = np.abs(v).max() if len(v) else 0.0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return bytes([int(kind[2])]) + v.astype(kind).tobytes()


def _dense(x: list[bytes], width: int) -> np.ndarray:
    """Packed vectors of one width as float64 rows."""
    out = np.zeros((len(x), width))
    sizes = np.array([b[0] for b in x])
    for size, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        of = np.flatnonzero(sizes == size)
        if len(of) and width:
            out[of] = np.frombuffer(b"".join(x[j][1:] for j in of), kind).reshape(len(of), width)
    return out


def integral(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _v, _n, _row) of the vectors that take part: components as packed integers, their number, the row's own number."""
    x = column(vector)
    fine = x.isNotNull() & F.forall(x, lambda y: F.coalesce(~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < math.inf), F.lit(False)))
    v = vectors.where(column(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(column(key).cast("long").alias("_id"), x.cast("array<double>").alias("_x"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1)
        offs = np.asarray(lists.offsets)
        flat = np.clip(np.floor(256.0 * np.asarray(lists.values, dtype=np.float64)), -(2.0**63), 2.0**63 - 1025)
        rows = [_packed(flat[a:e]) for a, e in zip(offs[:-1], offs[1:])]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array(np.diff(offs).astype(np.int32))], names=["_id", "_v", "_n"])

    # written, so that a row keeps its number whatever is run again
    return cut(map_arrow(v, run, "_id long, _v binary, _n int").withColumn("_row", F.monotonically_increasing_id()), "topk-vectors")


def top_k(vectors: DataFrame, query_mod: int, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by query_mod."""
    spark = vectors.sparkSession
    batched(spark)
    rows = integral(vectors, key, vector)
    asked = F.col("_id") % query_mod == 0
    n, nq, size = rows.agg(F.count("*"), F.count_if(asked), F.coalesce(F.sum(F.octet_length("_v")), F.lit(0))).first()
    # a task for each core while there are few tiles
    tiles = max(1, -(-nq // TILE))
    shards = max(1, -(-size // SHARD_BYTES), min(-(-n // STRIP), spark.sparkContext.defaultParallelism // tiles))
    h = F.xxhash64("_id", "_v", "_row")
    q = rows.where(asked).select("_id", "_row", "_v", "_n", F.lit(True).alias("_q"), F.pmod(h, F.lit(tiles)).cast("int").alias("_tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    c = rows.select("_id", "_row", "_v", "_n", F.lit(False).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile"), F.pmod(h, F.lit(shards)).cast("int").alias("_shard"))

    def cell(p: pd.DataFrame) -> pd.DataFrame:
        is_q = p["_q"].to_numpy(bool)
        qs, cs = p[is_q], p[~is_q].sort_values("_row")
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": [], "_shard": []}).astype("int64")
        width = int(p["_n"].iloc[0])
        qid, qrow = qs["_id"].to_numpy(), qs["_row"].to_numpy()
        s, i = cell_top(qrow, _dense(qs["_v"].tolist(), width), cs["_id"].to_numpy(), cs["_row"].to_numpy(), _dense(cs["_v"].tolist(), width), k)
        live = s != NONE
        wide = lambda x: np.repeat(x, k)[live.ravel()]
        return pd.DataFrame({"query_row": wide(qrow), "query_id": wide(qid), "vec_id": i[live], "score": s[live], "_shard": np.int64(p["_shard"].iloc[0])})

    lists = q.unionByName(c).groupBy("_n", "_tile", "_shard").applyInPandas(cell, "query_row long, query_id long, vec_id long, score long, _shard long")
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    while shards > FAN:  # merge FAN lists at a time
        shards = -(-shards // FAN)
        lists = lists.withColumn("_shard", (F.col("_shard") / FAN).cast("long")).withColumn("_r", F.row_number().over(best("query_row", "_shard"))).where(F.col("_r") <= k).drop("_r")
    out = lists.withColumn("rank", F.row_number().over(best("query_row"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), query_mod=50, k=5)


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum([x[1] * x[2] FOR x IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
