"""Token ids in files of patched frame-of-reference blocks.

File: magic, counts, an index of block starts, an index of document starts, document keys, then the blocks. A block
holds BLOCK ids: its minimum is subtracted, the differences are packed at the width that COVER of them need, and the
others, the exceptions, are listed with position and full difference after the packed words. Any block, and so any
document, can be read alone by way of the indexes. All coding is done on whole runs of blocks at a time.

Documents are range-partitioned by key and sorted (a key of any number of rows is split by the hash of its text, and rows
that are equal in both by their place, which changes nothing). Texts are shuffled, not ids: two bytes an id come to as
much as the compressed text, and range partitioning reads its input twice, so that ids would have to be written first.
A task writes its range as one or more files of up to FILE_IDS ids, and a manifest row per file (written by Spark, so that only files of successful attempts count) carries the numbers
from which a file's first id follows. The running sum over the manifest is over files, not documents.

Defined cases: a null or empty text is the end id alone; equal keys are ordered by the hash of their text, and repeated
rows are each written; null keys come first; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import vocabulary
from .public_vocab import byte_ids
from .work import batched, column, cut, filesystem, new_dir, qualified, table

MAGIC = b"MRPFOR01"
BLOCK = 256
COVER = 0.9
FILE_IDS = 8 << 20
#: Blocks coded at once.
RUN = 2048
_HEAD = 8  # minimum u32, width u8, zero u8, exceptions u16


def _pack(diff: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) differences to (n, 32 * width) bytes, low bits first."""
    t = np.ascontiguousarray(diff.T).astype(np.uint64)
    out = np.zeros((4 * width, len(diff)), np.uint64)
    for i in range(BLOCK if width else 0):
        word, at = divmod(i * width, 64)
        out[word] |= t[i] << np.uint64(at)
        if at + width > 64:
            out[word + 1] |= t[i] >> np.uint64(64 - at)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(diff), 32 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The reverse of _pack."""
    n = len(packed)
    out = np.zeros((BLOCK, n), np.uint64)
    if width:
        words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(n, 4 * width).T)
        mask = np.uint64((1 << width) - 1)
        for i in range(BLOCK):
            word, at = divmod(i * width, 64)
            x = words[word] >> np.uint64(at)
            if at + width > 64:
                x = x | (words[word + 1] << np.uint64(64 - at))
            out[i] = x & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of the ids (the last one filled up with its last id) and their sizes."""
    n = -(-len(ids) // BLOCK)
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows, out, sizes = padded.reshape(n, BLOCK), [], []
    for at in range(0, n, RUN):
        v = rows[at : at + RUN]
        low = v.min(axis=1)
        diff = v - low[:, None]
        bits = np.frexp(diff.astype(np.float64))[1]
        rank = int(np.ceil(COVER * BLOCK)) - 1
        width = np.partition(bits, rank, axis=1)[:, rank]
        over = bits > width[:, None]
        count = over.sum(axis=1)
        size = _HEAD + 32 * width + 5 * count
        start = np.cumsum(size) - size
        buf = np.zeros(int(size.sum()), np.uint8)
        head = np.zeros(len(v), np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("count", "<u2")]))
        head["low"], head["width"], head["count"] = low, width, count
        buf[start[:, None] + np.arange(_HEAD)] = head.view(np.uint8).reshape(len(v), _HEAD)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            if w:
                low_bits = diff[of] & np.uint32((1 << int(w)) - 1)
                buf[start[of][:, None] + _HEAD + np.arange(32 * w)] = _pack(low_bits, int(w))
        block, pos = np.nonzero(over)
        if len(block):
            nth = np.arange(len(block)) - (np.cumsum(count) - count)[block]
            base = start[block] + _HEAD + 32 * width[block]
            buf[base + nth] = pos
            buf[(base + count[block] + 4 * nth)[:, None] + np.arange(4)] = diff[block, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(buf.tobytes())
        sizes.append(size)
    return b"".join(out), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def decode_blocks(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the given places of buf."""
    out = np.empty((len(start), BLOCK), np.uint32)
    for at in range(0, len(start), RUN):
        s = start[at : at + RUN]
        head = buf[s[:, None] + np.arange(_HEAD)].reshape(-1).view(np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("count", "<u2")]))
        width, count = head["width"].astype(np.int64), head["count"].astype(np.int64)
        v = np.zeros((len(s), BLOCK), np.uint64)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            v[of] = _unpack(buf[s[of][:, None] + _HEAD + np.arange(32 * w)], int(w))
        if count.any():
            block = np.repeat(np.arange(len(s)), count)
            nth = np.arange(len(block)) - (np.cumsum(count) - count)[block]
            base = s[block] + _HEAD + 32 * width[block]
            v[block, buf[base + nth]] = buf[(base + count[block] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
        out[at : at + RUN] = v + head["low"][:, None]
    return out.reshape(-1)


def write_file(out: io.IOBase, keys: list, lengths: list[int], ids: np.ndarray) -> None:
    blocks, sizes = encode_blocks(ids)
    out.write(MAGIC + struct.pack("<QQQ", len(ids), len(keys), len(sizes)))
    out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
    out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
    out.write(np.array([k is not None for k in keys], np.uint8).tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes())
    out.write(blocks)


class Reader:
    """A file read whole or by document."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, n, blocks = struct.unpack_from("<QQQ", data, 8)
        take = lambda kind, count, at: (np.frombuffer(data, kind, count, at), at + np.dtype(kind).itemsize * count)
        self.block_start, at = take("<u8", blocks + 1, 32)
        self.doc_start, at = take("<u8", n + 1, at)
        known, at = take(np.uint8, n, at)
        keys, at = take("<i8", n, at)
        self.keys = [k if f else None for k, f in zip(keys.tolist(), known)]
        self.body = np.frombuffer(data, np.uint8, offset=at) if at < len(data) else np.zeros(0, np.uint8)

    def all(self) -> np.ndarray:
        return decode_blocks(self.body, self.block_start[:-1].astype(np.int64))[: self.n_ids]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from its own blocks alone."""
        a, b = int(self.doc_start[i]), int(self.doc_start[i + 1])
        first, last = a // BLOCK, -(-b // BLOCK)
        return decode_blocks(self.body, self.block_start[first:last].astype(np.int64))[a - first * BLOCK : b - first * BLOCK]


def write(docs: DataFrame, encode: Callable[[str], bytes], key: str = "doc_id", text: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write token files in ascending key order; the manifest: (part, seq, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    batched(spark)
    root = qualified(spark, path) if path else new_dir(spark, "tokens")
    end = int(end_id).to_bytes(4, "little")
    names = ["part", "seq", "path", "n_docs", "n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        fs.create_dir(folder, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[int] = []
        bufs: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                write_file(out, keys, lengths, np.frombuffer(b"".join(bufs), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, f"{root}/{name}", len(keys), held)], names=names)
            seq, held = seq + 1, 0
            keys.clear(), lengths.clear(), bufs.clear()
            return row

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = (encode(t) if t else b"") + end
                keys.append(k)
                lengths.append(len(ids) // 4)
                bufs.append(ids)
                held += len(ids) // 4
                if held >= FILE_IDS:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(column(key).cast("long").alias("_key"), column(text).cast("string").alias("_text")).withColumns({"_th": F.xxhash64("_text"), "_at": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange("_key", "_th", "_at").sortWithinPartitions("_key", "_th").select("_key", "_text")
    return cut(ranged.mapInArrow(run, "part long, seq long, path string, n_docs long, n_ids long"), "tokens-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    spark = manifest.sparkSession
    batched(spark)
    # one row per file
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as f:
                    r = Reader(f.read())
                raw, at = memoryview(r.all().astype("<u4").tobytes()), r.doc_start.astype(np.int64)
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r.keys, pa.int64()), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n, "path").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    manifest = write(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda t: byte_ids(t, path))
    return read(manifest).withColumnRenamed("key", "doc_id")
