"""Harmonic packing of token ids into sequences of a fixed capacity.

A length in (C/(k+1), C/k] belongs to class k, and a sequence of class k holds exactly k pieces, each in a slot of
C//k ids. Every worker fills the bins of its own documents: no shuffle, no shared state, so it scales with the input
and a lost task is simply run again. Because documents may be cut freely, a document gives off whole sequences first;
a rest that would leave over 1/SLACK of its slot empty gives off one full slot of the next class and its remainder is
classed again, which leaves little padding after two or three cuts. Pieces of bins that a worker couldn't fill are at
its end laid end to end over sequences, and the very last of these is cut at powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; a repeated row is packed again like any other; an empty table
gives no piece; ids come with their document's key and no other column takes part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .public_vocab import word_ids
from .work import batched, column, table

CAPACITY = 2048
#: A rest stays whole if at most this part of its slot would stay empty.
SLACK = 64
#: Rests of up to so many ids fill bins of their own length.
SMALL = 32


def split_lengths(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document, in order. Class 1 pieces are whole sequences."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if rest <= SMALL or slot - rest <= slot // SLACK:
            out.append((k, rest))
            break
        slot = capacity // (k + 1)
        out.append((k + 1, slot))
        rest -= slot
    return out


Piece = tuple[object, int, int, bytes]


class Packer:
    """Bins of one worker. put() and end() yield (sequence, [(document, start, length, offset, ids)]).

    An open bin holds its pieces' own ids, not their documents', so a worker's memory is that of its open bins: at most
    one sequence in each class, of which there are under 2 * SMALL * SLACK.
    """

    def __init__(self, base: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next = capacity, base
        self.open: dict[tuple[int, int], list[Piece]] = {}

    def _emit(self, pieces: list[Piece]) -> tuple[int, list[tuple[object, int, int, int, bytes]]]:
        out, at = [], 0
        for doc, start, n, ids in pieces:
            out.append((doc, start, n, at, ids))
            at += n
        self.next += 1
        return self.next - 1, out

    def put(self, doc: object, length: int, ids: bytes = b"") -> Iterator[tuple[int, list[tuple[object, int, int, int, bytes]]]]:
        start = 0
        for k, n in split_lengths(length, self.capacity):
            # short rests share bins with their own length only, so that k of them fill a bin
            bins = self.open.setdefault((k, n if n <= SMALL else 0), [])
            bins.append((doc, start, n, ids[4 * start : 4 * (start + n)]))
            start += n
            if len(bins) == k:
                yield self._emit(bins)
                del self.open[k, n if n <= SMALL else 0]

    def end(self) -> Iterator[tuple[int, list[tuple[object, int, int, int, bytes]]]]:
        rest = [p for key in sorted(self.open) for p in self.open[key]]
        self.open = {}
        left = sum(n for _, _, n, _ in rest)
        room = self.capacity if left >= self.capacity else _power(left)
        row: list[Piece] = []
        for doc, start, n, ids in rest:
            while n:
                cut = min(n, room)
                row.append((doc, start, cut, ids[: 4 * cut]))
                start, n, room, left, ids = start + cut, n - cut, room - cut, left - cut, ids[4 * cut :]
                if not room:
                    yield self._emit(row)
                    row = []
                    room = self.capacity if left >= self.capacity else _power(left)


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1) if n else 0


def pack(docs: DataFrame, encode: Callable[[str], bytes], key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, ids_crc32, and the ids themselves.

    encode gives a text's ids as little-endian 32-bit bytes. sequence_id is the worker's number times 2**33 plus its
    own count. Memory is bounded by the open bins of a worker, at most k pieces in each class.
    """
    batched(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[key].dataType.simpleString()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        rows: list[tuple] = []

        def take(full: Iterator) -> None:
            for seq, pieces in full:
                for (name, total), start, n, at, part in pieces:
                    rows.append((name, start, n, zlib.crc32(part), total, seq, at, part))

        def batch(key_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 8
            arrays = [pa.array(cols[0], key_type)] + [pa.array(c, t) for c, (_, t) in zip(cols[1:7], fields)]
            names = [key, *[f for f, _ in fields]]
            if ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(cols[2]), [None, pa.py_buffer(b"".join(cols[7]))])
                offs = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(cols[2], out=offs[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(offs), flat))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                buf = (encode(t) if t else b"") + end
                take(packer.put((name, len(buf) // 4), len(buf) // 4, buf))
                if len(rows) >= 2000:
                    yield batch(key_type)
        take(packer.end())
        if rows:
            yield batch(key_type)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if ids else "")
    return docs.select(column(key), column(text).cast("string").alias("_text")).mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_words(docs: DataFrame, ids: bool = False) -> DataFrame:
    """pack() with the lower-casing word vocabulary and end id 1."""
    path = vocabulary("word_bpe_49k.json")
    return pack(docs, lambda t: word_ids(t, path), ids=ids)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
