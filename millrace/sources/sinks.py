"""Sinks: JSON lines, flat 16-bit token streams and packed arrays, each written by tasks and committed by a rename or a manifest."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .tree import open_fs


def jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing target is refused unless overwrite is set. Spark's commit shows all of it or nothing."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


class _Commit(WriterCommitMessage):
    def __init__(self, name: str, rows: int, ids: int) -> None:
        self.name, self.rows, self.ids = name, rows, ids


class TokenWriter(DataSourceArrowWriter):
    """Parts are written under a name of their own and listed in meta.json at commit: readers see committed parts alone."""

    def __init__(self, options: dict, kind: str) -> None:
        self.path, self.kind, self.end = options["path"], kind, int(options.get("end", -1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.{self.kind}"
        rows = ids = 0
        held: list[np.ndarray] = []
        labels: list[np.ndarray] = []
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in iterator:
                col = b.column(b.schema.get_field_index("ids"))
                if "labels" in b.schema.names:
                    labels += [np.asarray(x.values, dtype=np.int32) for x in b.column(b.schema.get_field_index("labels"))]
                for x in col:
                    v = np.asarray(x.values if x.is_valid else [], dtype=np.int64)
                    if self.kind == "bin" and len(v) and (v.max() > 65535 or v.min() < 0):
                        raise ValueError("an id doesn't fit 16 bits")
                    if self.end >= 0:
                        v = np.append(v, self.end)
                    rows, ids = rows + 1, ids + len(v)
                    if self.kind == "bin":
                        out.write(v.astype("<u2").tobytes())
                    else:
                        held.append(v)
            if self.kind == "npz":
                buf = io.BytesIO()
                dense = lambda rows, kind: np.stack(rows).astype(kind) if rows else np.zeros((0, 0), kind)
                np.savez_compressed(buf, input_ids=dense(held, np.uint16), **({"labels": dense(labels, np.int32)} if labels else {}))
                out.write(buf.getvalue())
        return _Commit(name, rows, ids)

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        got = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/meta.json") as out:
            out.write(json.dumps({"parts": [m.name for m in got], "rows": sum(m.rows for m in got), "tokens": sum(m.ids for m in got), "dtype": "uint16"}).encode())

    def abort(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class TokenBin(DataSource):
    """Format "token_bin": a flat stream of 16-bit ids per part, each row's ids followed by option `end`."""

    @classmethod
    def name(cls) -> str:
        return "token_bin"

    def schema(self) -> str:
        return "ids array<int>"

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, "bin")


class TokenNpz(TokenBin):
    """Format "token_npz": rows of one length as a dense matrix per part, and their labels as another if there are any."""

    @classmethod
    def name(cls) -> str:
        return "token_npz"

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, "npz")


def files(df: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Each row's text as a file of a tree; the number of files. Tasks write under the final names: the same row writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = f"{base}/{name}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at, compression=None) as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return df.select(path, text).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def register(spark) -> None:
    spark.dataSource.register(TokenBin)
    spark.dataSource.register(TokenNpz)


def epoch_order(df: DataFrame, seed: int, epoch: int, *key: str) -> DataFrame:
    """Rows in the hash order of an epoch: the cursor of a resumed run is a row number."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *map(F.col, key)), 256))
