"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, suffix: str) -> str:
    """A name that no other attempt of a task uses.

    Readers follow the manifest that Spark commits from the rows of successful
    attempts, so what a failed or repeated attempt leaves behind is never read.
    """
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


@contextmanager
def create(uri: str):
    where, path = _at(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
        yield out


@contextmanager
def open_random(uri: str):
    where, path = _at(uri)
    with where.open_input_file(path) as f:
        yield f
