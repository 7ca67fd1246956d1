"""Files in the session's shared folder, written and mapped by tasks."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark import TaskContext


def as_uri(folder: str) -> str:
    return re.sub(r"^(file:)?/(?!/)", "file:///", folder)


def put(folder: str, name: str, content: bytes) -> None:
    """Write a file in one step, so a task that runs again replaces it by the same one."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(as_uri(folder))
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as out:
        out.write(content)
    store.move(attempt, f"{path}/{name}")


def mapped(folder: str, name: str) -> np.ndarray:
    """The file's bytes, memory-mapped; empty where there is no such file.

    A file of another store than the local one is copied to an unnamed temporary file first, which
    goes when the task's process does.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{as_uri(folder)}/{name}")
    info = store.get_file_info(path)
    if info.type != fs.FileType.File or not info.size:
        return np.zeros(0, np.uint8)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    copy = tempfile.TemporaryFile()
    with store.open_input_stream(path) as source:
        while chunk := source.read(1 << 22):
            copy.write(chunk)
    copy.flush()
    return np.memmap(copy, np.uint8, "r")


def drop(folder: str, name: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{as_uri(folder)}/{name}")
    store.delete_file(path)
