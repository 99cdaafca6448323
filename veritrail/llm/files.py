"""Files that tasks write below the shared folder: any store that pyarrow opens by URI."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path on it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def growing(uri: str) -> Iterator[pa.NativeFile]:
    """A file to write to under another name, which is moved once it is whole: a reader finds all of it or nothing, and a repeated task replaces it."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt, compression=None) as f:
        yield f
    fs.move(attempt, path)


def put(uri: str, data: bytes) -> None:
    with growing(uri) as f:
        f.write(data)


def get(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def lines(uri: str) -> Iterator[str]:
    """The lines of a text file, read as they are asked for."""
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        yield from io.TextIOWrapper(io.BufferedReader(f), "utf-8")
