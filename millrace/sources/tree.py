"""Trees of many small files, listed and read by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs

#: Rows and bytes of a batch.
ROWS, BYTES = 4096, 1 << 23


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it. Spark's local paths are not percent-encoded."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def _list(fs: pafs.FileSystem, at: str) -> Iterator[tuple[str, bool]]:
    """(name, is a folder) of a folder; links to folders are not followed, as they may lead back."""
    if isinstance(fs, pafs.LocalFileSystem):  # one entry at a time, however many there are
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True
                elif os.path.isfile(e.path) if e.is_symlink() else e.is_file():
                    yield e.name, False
        return
    for e in fs.get_file_info(pafs.FileSelector(at)):
        if e.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield e.base_name, e.type == pafs.FileType.Directory


def entries(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, folder) of what the folders hold, paths below the root."""
    fs, base = open_fs(root)
    held: list[tuple[str, bool]] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([d for _, d in held], pa.bool_())], names=["path", "folder"])
    for b in batches:
        for folder in b.column(0).to_pylist():
            for name, is_folder in _list(fs, f"{base}/{folder}".rstrip("/")):
                held.append((f"{folder}/{name}" if folder else name, is_folder))
                if len(held) >= ROWS:
                    yield flush()
                    held.clear()
    if held:
        yield flush()


def contents(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of files, paths below the root."""
    fs, base = open_fs(root)
    held: list[tuple[str, bytes]] = []
    size = 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], names=["path", "content"])
    for b in batches:
        for path in b.column(0).to_pylist():
            with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                held.append((path, f.read()))
            size += len(held[-1][1])
            if len(held) >= ROWS or size >= BYTES:
                yield flush()
                held.clear()
                size = 0
    if held:
        yield flush()
