"""WARC archives with a two-level capture index.

Records are written as WARC/1.1, one gzip member each, by every task on its own into files of about FILE_BYTES. Of
captures with equal payloads (of at least `least` bytes) that with the largest id is the response; the others are
revisit records, which hold the HTTP head alone and name the response.

Index: captures are range-partitioned by reversed-host key and id and sorted; each part is a file of compressed blocks of
BLOCK_LINES lines, then its block directory (first key and place of each block), then a footer. A second, still
sparser level is the list of parts with their first keys; parts are at most as many as shuffle partitions, so it may be
sent to tasks. A lookup searches the parts, reads one directory, searches it, reads one block, searches that, and
range-reads the record. `locate` does so for a table of keys: they are sorted into the parts, so that a task has one
directory and one block at a time; `fetch` then reads the records by file and place, READ_BYTES of them a task.

Every file's name is unique to the attempt that wrote it, and only files named in a manifest that Spark committed
are read, so a lost executor's half-written files never count. Groups of equal payloads are settled on digests, and the
payloads of a group of any size stay where they are (`skew_lookup`).

Defined cases: a null payload is empty; a null url has the empty key and no target; rows with the same id and payload
are all responses if theirs is the largest id; a null id is never the largest, unless the group has no other; an empty
table gives no archive and an empty result; other columns take no part.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import batched, cut, filesystem, new_dir, qualified, skew_lookup, table

FILE_BYTES = 64 << 20
#: Bytes of records that a task reads.
READ_BYTES = 32 << 20
BLOCK_LINES = 256
_FOOT = "<8sQQ"
_MAGIC = b"MRCDX001"
_CTL = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """The reversed-host key of a url: scheme, port 80 or 443, user, leading www and fragment don't count."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip() if "//" in url else f"//{url.strip()}")
        host, port = (p.hostname or "").rstrip("."), p.port
    except ValueError:
        return _CTL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")
    return _CTL.sub(lambda m: f"%{ord(m[0]):02X}", key)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    """The record id of a capture; the id can be read from it."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 127) if page_id is None else page_id & (1 << 64) - 1)}>"


def _id(name: str) -> int | None:
    x = uuid.UUID(name[10:-1]).int
    return None if x >> 127 else x - (1 << 64) if x >> 63 else x


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """One record as a gzip member; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + _CTL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to[0])}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """A record's headers, page_id, record_type, refers_to, payload (None in a revisit), payload_bytes and payload_digest.

    The digest and size of a response are computed from its payload, and its own statement of them must agree.
    """
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != said):
        raise ValueError("the payload isn't what the record says")
    return {
        "headers": h,
        "page_id": _id(h["WARC-Record-ID"]),
        "record_type": h["WARC-Type"],
        "refers_to": _id(h["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": said,
    }


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with _refers: null for a response, else a struct of the id that it revisits."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("_d", F.when(F.octet_length("html") >= least, F.concat(F.sha1("html"), F.octet_length("html").cast("string"))))
    groups = p.where(F.col("_d").isNotNull()).groupBy("_d").agg(F.max("page_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    j = skew_lookup(p, cut(groups, "warc-groups"), "_d", "_n", "left")
    first = F.col("_best").isNull() | F.col("page_id").eqNullSafe(F.col("_best"))
    return j.select("page_id", "url", "html", F.when(~first, F.struct(F.col("_best").alias("id"))).alias("_refers"))


def write(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write archives; the captures: (surt, page_id, path, offset, length)."""
    spark = pages.sparkSession
    batched(spark)
    root = qualified(spark, path) if path else new_dir(spark, "warc")
    names = ["surt", "page_id", "path", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for pid, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                data = record(pid, url, html.encode(), None if refers is None else (refers["id"],))
                out.write(data)
                rows.append((surt(url), pid, f"{root}/{name}", at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=names)
        if out is not None:
            out.close()

    return cut(decide(pages, least).mapInArrow(run, "surt string, page_id long, path string, offset long, length long"), "warc-captures")


def _line(row: tuple) -> bytes:
    return json.dumps(row, separators=(",", ":")).encode()


Key = tuple[str, bool, int]


def _key(surt: str, page_id: int | None) -> Key:
    """The place of a capture in the index: null ids come first, as Spark sorts them."""
    return surt, page_id is not None, page_id or 0


def build_index(captures: DataFrame, path: str | None = None) -> DataFrame:
    """Write the index of captures; its upper level: (part, first, first_id, path, blocks), one row per part."""
    spark = captures.sparkSession
    batched(spark)
    root = qualified(spark, path) if path else new_dir(spark, "warc-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"index-{part:06d}-{uuid.uuid4().hex}.cdx"
        out, at, block, directory = None, 0, [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress(b"\n".join(_line(r) for r in block), 6)
            directory.append((*block[0][:2], at, len(data)))
            out.write(data)
            at += len(data)
            block.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out = out or fs.open_output_stream(f"{folder}/{name}", compression=None)
                block.append(row)
                if len(block) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        data = zlib.compress(b"\n".join(_line(r) for r in directory), 6)
        out.write(data + struct.pack(_FOOT, _MAGIC, at, len(data)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([f"{root}/{name}"]), pa.array([len(directory)], pa.int64())], names=["part", "first", "first_id", "path", "blocks"])

    ranged = captures.select("surt", "page_id", "path", "offset", "length").repartitionByRange("surt", "page_id", "path", "offset").sortWithinPartitions("surt", "page_id", "path", "offset")
    return cut(ranged.mapInArrow(run, "part long, first string, first_id long, path string, blocks long"), "warc-parts")


def _read_at(path: str, at: int, n: int) -> bytes:
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        return f.read_at(n, at)


def directory(path: str) -> tuple[list[Key], list[tuple[int, int]]]:
    """The first key of each block of an index part, and its place and size."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        magic, at, n = struct.unpack(_FOOT, f.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
        if magic != _MAGIC:
            raise ValueError("not an index part")
        rows = [json.loads(x) for x in zlib.decompress(f.read_at(n, at)).split(b"\n")]
    return [_key(*r[:2]) for r in rows], [(r[2], r[3]) for r in rows]


def block(path: str, at: int, n: int) -> tuple[list[Key], list[tuple[str, int, int]]]:
    """The keys of a block's lines, and the file, place and size of each line's record."""
    rows = [json.loads(x) for x in zlib.decompress(_read_at(path, at, n)).split(b"\n")]
    return [_key(*r[:2]) for r in rows], [tuple(r[2:]) for r in rows]


class Index:
    """The parts of an index, searched from the top: parts, then a part's directory, then a block. The last of each is kept."""

    def __init__(self, parts: list[tuple[str, int | None, str]]) -> None:
        """parts: (first key, first id, path) in order."""
        self.first, self.paths = [_key(*p[:2]) for p in parts], [p[2] for p in parts]
        self.part, self.at = None, None

    def part_of(self, key: Key) -> int:
        """The first part that may hold a key: captures of one key may go on in the next one."""
        return max(0, bisect.bisect_left(self.first, key) - 1)

    def find(self, low: Key, high: Key) -> Iterator[tuple[str, int, int]]:
        """The records of all captures from one key to another, both included."""
        for i in range(self.part_of(low), len(self.first)):
            if self.first[i] > high:
                break
            if self.part != i:
                self.part, self.at, self.dir = i, None, directory(self.paths[i])
            keys, places = self.dir
            for j in range(max(0, bisect.bisect_left(keys, low) - 1), len(keys)):
                if keys[j] > high:
                    break
                if self.at != j:
                    self.at, self.lines = j, block(self.paths[i], *places[j])
                names, records = self.lines
                yield from records[bisect.bisect_left(names, low) : bisect.bisect_right(names, high)]


def tops(parts: DataFrame) -> list[tuple[str, int | None, str]]:
    """The upper level of an index: a row per part, of which there are no more than shuffle partitions."""
    return [tuple(r) for r in parts.orderBy("part").select("first", "first_id", "path").collect()]


def lookup(index: Index, url: str | None) -> list[dict]:
    """The records of all captures of a url."""
    key = surt(url)
    return [parse(_read_at(*r)) for r in index.find((key, False, 0), (key, True, (1 << 63) - 1))]


def locate(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, offset, length) of the captures of each distinct (surt, page_id) in keys, by search in the index."""
    spark = keys.sparkSession
    batched(spark)
    sent = spark.sparkContext.broadcast(tops(parts))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for b in batches:
            at = [index.part_of(_key(s, i)) for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["surt", "page_id", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for b in batches:
            found = (r for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in index.find(_key(s, i), _key(s, i)))
            while rows := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["path", "offset", "length"])

    asked = keys.select("surt", "page_id").distinct().mapInArrow(assign, "surt string, page_id long, part long")
    return asked.repartition(max(1, len(sent.value)), "part").sortWithinPartitions("part", "surt", "page_id").mapInArrow(search, "path string, offset long, length long")


def fetch(places: DataFrame) -> DataFrame:
    """The records at (path, offset, length), parsed and checked: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    batched(places.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        for b in batches:
            rows = []
            for path, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if path != last:
                    fs, name = filesystem(path)
                    last, f = path, fs.open_input_file(name)
                r = parse(f.read_at(n, at))
                rows.append([r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    places = cut(places, "warc-places")
    spark, size = places.sparkSession, places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, size // READ_BYTES + 1)
    stretch = F.floor(F.col("offset") / READ_BYTES)  # a file is read in stretches, so that its size bounds no task
    return places.repartition(n, "path", stretch).sortWithinPartitions("path", "offset").mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Writes the archives and their index, then looks every capture up in the index and reads its record."""
    captures = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return fetch(locate(captures, build_index(captures)))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (5 * (3 - i % 4))::INT) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to
FROM d
"""
