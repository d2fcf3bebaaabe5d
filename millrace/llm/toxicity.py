"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, its word pairs and its pairs with one or two words left
out, over the whole text, folded to DIMS coordinates. Training follows the FTRL-proximal rule with one learning rate
per coordinate and an L1 term, which leaves most weights at zero: the model is a list of at most DIMS (index, weight)
pairs, so what scoring broadcasts is bounded by DIMS whatever the corpus.

Training reads at most `max_rows` labelled documents (lowest hash of doc_id first), and of these as many as have up to
`max_features` coordinates together: two documented bounds of the one task that learns. That task holds the rows as they
were shuffled, some two bytes a coordinate (`pack`), and puts them in order itself: a sort in the JVM would hold them all
once more beside it. Scoring reads every document whole, one pass without a shuffle.

Defined cases: a null or empty text has no feature and gets the score of the bias alone; repeated rows get equal scores
and are learnt from once, before the shuffle (of several texts with one id, from that with the least coordinates by order);
labels that are null or whose document is absent are ignored, a doc_id labelled both ways counts as toxic; with no labels
at all the score is 0; extra columns, whatever their names, do not take part. A null doc_id is scored and never held out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .work import batched, map_arrow, map_columns, table

BITS = 20
DIMS = 1 << BITS
#: Bytes of text whose features are found at once: the arrays for them are some fifty times as large.
CHUNK = 1 << 18
U64 = np.uint64
_SALT = [U64(x) for x in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5, 0x165667B19E3779F9)]


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, pair and skip pair, repeats included."""
    folded, starts, ends, rows = tb.words(data, bounds)
    h = tb.hashes(folded, starts, ends)
    all_rows, all_cols = [rows], [(tb.mix(h ^ _SALT[0]) >> U64(64 - BITS)).astype(np.int32)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = rows[:-gap] == rows[gap:]
            pair = tb.mix(h[:-gap] * U64(0x9E3779B97F4A7C15) + tb.mix(h[gap:] + _SALT[gap]))
            all_rows.append(rows[:-gap][same])
            all_cols.append((pair[same] >> U64(64 - BITS)).astype(np.int32))
    return np.concatenate(all_rows), np.concatenate(all_cols)


def _distinct(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows.astype(np.int64) << BITS) | cols)
    return both >> BITS, (both & (DIMS - 1)).astype(np.int32)


def pack(rows: np.ndarray, cols: np.ndarray, n: int) -> list[bytes]:
    """The distinct coordinates of each of n rows as bytes that sort as the lists of coordinates do.

    Gaps under 2^15 are two bytes, big end first; others four, of which only the first pair has its high bit set.
    """
    gap = cols.astype(np.int64)
    gap[1:] -= np.where(rows[1:] == rows[:-1], cols[:-1], 0)
    wide = gap >> 15 > 0
    ends = np.cumsum(1 + wide)
    out = np.empty(int(ends[-1]) if len(ends) else 0, ">u2")
    out[ends - 1] = gap & 0x7FFF
    out[ends[wide] - 2] = 0x8000 | gap[wide] >> 15
    at = np.concatenate([[0], ends])[np.searchsorted(rows, np.arange(n + 1))].tolist()
    raw = out.tobytes()
    return [raw[2 * i : 2 * j] for i, j in zip(at[:-1], at[1:])]


def unpack(raw: bytes) -> np.ndarray:
    """The coordinates of one row."""
    gap = np.frombuffer(raw, ">u2").astype(np.int32)
    wide = np.flatnonzero(gap & 0x8000)
    if len(wide):
        gap[wide + 1] += (gap[wide] & 0x7FFF) << 15
        gap = np.delete(gap, wide)
    return np.cumsum(gap, dtype=np.int32)


def coordinates(raw: bytes) -> int:
    """How many coordinates a packed row has."""
    return int((np.frombuffer(raw, ">u2") < 0x8000).sum())


def first_rows(rows: Iterator[tuple[int, int, int, bytes]], max_features: int) -> list[tuple[int, bytes]]:
    """(label, packed coordinates) of the rows (hash, id, label, packed coordinates), which come in any order, in that of
    hash and id: as many from the first on as have up to max_features coordinates together. No more are held at any time."""
    heap: list[tuple[int, int, int, int, bytes]] = []  # the last row in order is on top
    left, end = max_features, None
    for h, k, y, raw in rows:
        if end is None or (h, k) < end:
            n = coordinates(raw)
            heapq.heappush(heap, (-h, -k, n, y, raw))
            left -= n
            while left < 0:
                h, k, n, _, _ = heapq.heappop(heap)
                left, end = left + n, (-h, -k)
    return [(y, raw) for _, _, _, y, raw in sorted(heap, reverse=True)]


class Ftrl:
    """FTRL-proximal for binary features; coordinate DIMS is the bias, which carries no L1."""

    def __init__(self, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(DIMS + 1)
        self.n = np.zeros(DIMS + 1)

    def _solve(self, z: np.ndarray, root: np.ndarray, l1: float | np.ndarray) -> np.ndarray:
        return (np.clip(z, -l1, l1) - z) / ((self.beta + root) / self.alpha + self.l2)

    def weights(self, at: np.ndarray) -> np.ndarray:
        return self._solve(self.z[at], np.sqrt(self.n[at]), np.where(at == DIMS, 0.0, self.l1))

    def learn(self, at: np.ndarray, y: int) -> None:
        """One row; `at` are its coordinates without the bias."""
        z, n = self.z[at], self.n[at]
        root = np.sqrt(n)
        w = self._solve(z, root, self.l1)
        zb, nb = self.z[DIMS], self.n[DIMS]
        wb = self._solve(zb, nb**0.5, 0.0)
        g = sigmoid(float(w.sum() + wb)) - y
        self.z[at] = z + g - (np.sqrt(n + g * g) - root) / self.alpha * w
        self.n[at] = n + g * g
        self.z[DIMS] = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / self.alpha * wb
        self.n[DIMS] = nb + g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1.0 + e)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 25_000, max_features: int = 1 << 26, epochs: int = 5, held_out_mod: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights (indices, values, bias) learnt from labelled rows whose crc32(doc_id) mod held_out_mod is not 0."""
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % held_out_mod != 0))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def featurise(b: pa.RecordBatch) -> pa.RecordBatch:
        packed: list[bytes] = []
        for i, j, data, bounds in tb.chunks(b.column(1), CHUNK):
            packed.extend(pack(*_distinct(*features(data, bounds)), j - i))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["doc_id", "y", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = first_rows((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), max_features)
        if not seen:
            return
        model = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(seen)):
                y, raw = seen[k]
                model.learn(unpack(raw), y)
        w = model.weights(np.arange(DIMS + 1))
        at = np.flatnonzero(w[:DIMS]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"at": [at.tolist()], "w": [w[at].tolist()], "bias": [float(w[DIMS])]}, pa.schema([("at", pa.list_(pa.int32())), ("w", pa.list_(pa.float64())), ("bias", pa.float64())]))

    batched(docs.sparkSession)
    sample = map_arrow(rows.select("doc_id", "text", "y"), featurise, "doc_id long, y int, at binary")
    # one row an id: repeated rows are combined where they are, so what the one task reads has a bound
    sample = sample.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("at").alias("at"))
    got = sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", "at").coalesce(1).mapInArrow(fit, "at array<int>, w array<double>, bias double").collect()
    if not got:
        return np.zeros(0, np.int32), np.zeros(0), -math.inf
    return np.array(got[0]["at"], np.int32), np.array(got[0]["w"]), got[0]["bias"]


def score_arrays(col: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(col), bias)
    for i, j, data, bounds in tb.chunks(col, CHUNK):
        r, c = features(data, bounds)
        live = dense[c] != 0
        r, c = _distinct(r[live], c[live])
        np.add.at(out, i + r, dense[c])
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-out))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score column; the other columns pass through unchanged."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most DIMS pairs

    if into in docs.columns:
        raise ValueError(f"docs has a column {into} already")
    text_at = docs.columns.index(text)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        at, w, bias = sent.value
        dense = np.zeros(DIMS)
        dense[at] = w
        return [*columns, pa.array(score_arrays(columns[text_at], dense, bias))]

    return map_columns(docs, run, [*docs.schema.fields, T.StructField(into, T.DoubleType())])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, table(spark, sf_dir, "labels"))
    s = score(docs, model)
    return s.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
