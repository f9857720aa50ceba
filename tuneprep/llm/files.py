"""Binary files in the shared folder, written and read inside tasks.

Paths are those of ``spark.checkpoint.dir`` and go through pyarrow's file systems, so
that folder must be one pyarrow can open (file, hdfs, s3, gs). A file is written under
a temporary name and then moved, so a lost executor leaves no half-written shard under
a final name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def open_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@contextmanager
def new_file(path: str) -> Iterator:
    """An output stream whose file appears under ``path`` when it is complete."""
    system, inner = open_system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    temporary = f"{inner}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as stream:
        yield stream
    system.move(temporary, inner)


@contextmanager
def open_file(path: str) -> Iterator:
    system, inner = open_system(path)
    with system.open_input_file(inner) as source:
        yield source
