"""Binary files in a folder that all executors share, written and read inside tasks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a mounted folder."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_new(folder: str, suffix: str, data: bytes) -> str:
    """Write a file of a name never used before and return its URI.

    A task that runs again writes another file; only the name that the finished
    attempt reports is ever read.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


def read_all(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as file:
        return file.read()


@contextlib.contextmanager
def ranges(uri: str) -> Iterator[tuple[Callable[[int, int], bytes], int]]:
    """``read(offset, length)`` over a file that stays open, and the file's size."""
    system, path = place(uri)
    with system.open_input_file(path) as file:
        yield lambda at, length: file.read_at(length, at), file.size()
