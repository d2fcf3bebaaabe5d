"""Vectorised handling of UTF-8 text in Arrow buffers: word bounds and 64-bit word hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 2 << 20
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

#: Letters, digits and all bytes of non-ASCII characters belong to words; A-Z become a-z; the rest parts words.
WORD = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 0x80:
        WORD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds in them) of runs of rows of about `size` bytes. A null is an empty text."""
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    bounds = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:
        lengths = np.where(np.asarray(col.is_valid()), np.diff(bounds), 0)
        if int(np.diff(bounds).sum()) != int(lengths.sum()):  # bytes under a null
            col = col.fill_null("")
            yield from chunks(col, size)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (8 zero bytes longer), and the start, end and row of each word; words end where rows do."""
    n = len(data)
    folded = np.zeros(n + 8, dtype=np.uint8)
    np.take(table, data, out=folded[:n])
    inside = folded[:n] != 0
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    inner = bounds[1:-1]
    edge = inner[inner < n]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(bounds, starts, side="right") - 1
    return folded, starts, ends, rows


def hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    lanes = np.ndarray((max(0, len(folded) - 7),), dtype="<u8", buffer=folded.data, strides=(1,)) if len(folded) >= 8 else np.zeros(1, np.uint64)
    h = mix((ends - starts).astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    left, at, live = ends - starts, starts.copy(), None
    while len(at):
        lane = lanes[at] & _LOW[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ lane)
        else:
            h[live] = mix(h[live] ^ lane)
        more = left > 8
        if not more.any():
            break
        live = np.flatnonzero(more) if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def char_offsets(data: np.ndarray) -> np.ndarray:
    """For each byte offset (the end included) the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
