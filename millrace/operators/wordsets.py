"""Word sets as packed columns: prefixes, sketches and codes, made and compared in Arrow batches.

A set is an array of 64-bit hashes. Frequent words have a place in a bounded table, rarest first; a code holds the places as
differences of one to three bytes and the other words' hashes whole, so it is exact and a fraction of the array's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Places in the table at most, and the bits that hold one.
PLACES, BITS = 1 << 18, 20
#: Elements of sets that are handled at a time.
ELEMENTS = 1 << 19


def places(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, their places from 1, rarest first) of words x with their counts f."""
    x, f = (np.asarray(counts[c], dtype=np.int64) for c in ("x", "f"))
    place = np.empty(len(x), np.int64)
    place[np.lexsort((x, f))] = np.arange(1, len(x) + 1)
    by_hash = np.argsort(x)
    return x[by_hash], place[by_hash].astype(np.int32)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ELEMENTS in all, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ELEMENTS, "right")))
        yield at, stop
        at = stop


def _ragged(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a list or binary column."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if pa.types.is_binary(col.type) else np.asarray(col.values)
    return data[off[0] : off[-1]], off - off[0]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_offsets(sizes).astype(np.int32)), pa.py_buffer(data)])


def _longs(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(sizes), pa.int32()), pa.array(data, pa.int64()))


def _bytes(place: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Ascending places as differences, seven bits a byte."""
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    d = place - np.where(first, 0, np.concatenate([[0], place[:-1]])[: len(row)])
    size = 1 + (d >= 1 << 7) + (d >= 1 << 14)
    start = _offsets(size)
    out = np.zeros(start[-1], np.uint8)
    for k in range(3):
        has = size > k
        out[start[:-1][has] + k] = (d[has] >> 7 * k & 127) | (size[has] > k + 1) << 7
    return _binary(out, np.bincount(row, size, rows).astype(np.int64))


def _places(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of what _bytes made."""
    data, off = _ragged(col)
    end = np.flatnonzero(data < 128)
    start = np.concatenate([[0], end + 1])[: len(end)]
    d = np.zeros(len(end), np.int64)
    for k in range(3):
        has = end - start >= k
        d[has] |= (data[start[has] + k] & 127).astype(np.int64) << 7 * k
    row = np.searchsorted(off, start, "right") - 1
    total = _offsets(d)
    return row, total[1:] - total[np.searchsorted(start, off[:-1])][row]


def _pack(w: pa.Array, known: np.ndarray, place_of: np.ndarray, threshold: float) -> list[pa.Array]:
    flat, off = _ragged(w)
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    place = np.zeros(len(flat), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        place = np.where(known[at] == flat, place_of[at], 0).astype(np.int64)
    # words without a place are the rarest, in the order of their hashes
    order = np.argsort(row << BITS | place, kind="stable")
    flat, place = flat[order], place[order]
    most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    prefix = flat[np.arange(len(flat)) - off[row] < most[row]]
    rare = place == 0
    bits = 1 << np.maximum(6, np.ceil(np.log2(n)).astype(np.int64))
    base = _offsets(bits)
    odd = np.bincount(base[row] + (flat & (bits - 1)[row]), minlength=base[-1]).astype(np.uint8) & 1
    return [
        pa.array(n, pa.int32()),
        _longs(prefix, most),
        _bytes(place[~rare], row[~rare], len(n)),
        _longs(flat[rare], np.bincount(row[rare], minlength=len(n))),
        _binary(np.packbits(odd), bits // 8),
    ]


def pack(df: DataFrame, known: np.ndarray, place_of: np.ndarray, threshold: float) -> DataFrame:
    """(id, c, n, prefix, code, rare, sketch) of (id, c, w): a set's size, its n - ceil(t n) + 1 rarest words, its code, and for
    each bucket of hashes whether it has an odd number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _pieces(np.diff(_ragged(b.column(2))[1])):
                p = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), *_pack(p.column(2), known, place_of, threshold)], names=["id", "c", "n", "prefix", "code", "rare", "sketch"])

    kind = dict(df.dtypes)["id"]
    return df.select("id", "c", "w").mapInArrow(run, f"id {kind}, c long, n int, prefix array<long>, code binary, rare array<long>, sketch binary")


def _differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many buckets two sketches differ; the longer one is folded to the length of the other."""
    (x, xo), (y, yo) = _ragged(a), _ragged(b)
    xn, yn = np.diff(xo), np.diff(yo)
    out = np.zeros(len(xn), np.int64)
    for s, t in {*zip(xn.tolist(), yn.tolist())}:
        at = np.flatnonzero((xn == s) & (yn == t))
        short = min(s, t)
        fold = lambda data, off, size: np.bitwise_xor.reduce(data[off[at][:, None] + np.arange(size)].reshape(len(at), -1, short), axis=1)  # noqa: E731, B023
        out[at] = np.bitwise_count(fold(x, xo, s) ^ fold(y, yo, t)).sum(axis=1)
    return out


def may_match(pairs: DataFrame, threshold: float) -> DataFrame:
    """(left, right) of (left, right, n, m, a, b) whose sketches a and b allow that similarity: a word in one set alone changes one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _pieces(np.asarray(b.column(2)).astype(np.int64)):
                p = b.slice(lo, hi - lo)
                both = np.asarray(p.column(2)).astype(np.int64) + np.asarray(p.column(3))
                fine = _differing(p.column(4), p.column(5)) <= both * ((1 - threshold) / (1 + threshold)) + 1e-9
                yield p.select([0, 1]).filter(pa.array(fine))

    kind = dict(pairs.dtypes)
    return pairs.select("left", "right", "n", "m", "a", "b").mapInArrow(run, f"left {kind['left']}, right {kind['right']}")


def _common(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> np.ndarray:
    """How many words the sets of codes a and b share, with the rare words c and d."""
    key = np.sort(np.concatenate([row << BITS | place for row, place in (_places(a), _places(b))]))
    got = np.bincount(key[1:][key[1:] == key[:-1]] >> BITS, minlength=len(a))
    parts = [(v, np.repeat(np.arange(len(a)), np.diff(off))) for v, off in (_ragged(c), _ragged(d))]
    word, row = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    return got + np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=len(a))


def matching(pairs: DataFrame, threshold: float) -> DataFrame:
    """(left, right, jaccard) of (left, right, n, m, a, b, c, d) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _pieces(np.asarray(b.column(2)).astype(np.int64)):
                p = b.slice(lo, hi - lo)
                both = np.asarray(p.column(2)).astype(np.int64) + np.asarray(p.column(3))
                common = _common(*(p.column(k) for k in range(4, 8)))
                jaccard = common / (both - common)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(jaccard)], names=["left", "right", "jaccard"]).filter(pa.array(jaccard >= threshold))

    kind = dict(pairs.dtypes)
    return pairs.select("left", "right", "n", "m", "a", "b", "c", "d").mapInArrow(run, f"left {kind['left']}, right {kind['right']}, jaccard double")
