"""Shared scratch storage: where plans are cut and intermediate tables are written.

Tables go to the folder the cluster names in ``spark.checkpoint.dir``, so every
executor sees them and a lost executor costs nothing but a re-read. The session's own
settings are left as they are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str | None] = ContextVar("tuneprep_scratch", default=None)
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may lack it; it gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context_dir.isDefined():
        return context_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tuneprep-")
    return _local[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tuneprep/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, below the current scope or this application's part of the shared folder."""
    return f"{_scope.get() or _app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it exists."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the complete folder ``new`` in the place of ``path``, which may hold an earlier one.

    The earlier folder steps aside by a rename and is deleted last; if ``new`` cannot take
    its place, it comes back.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target, aside = hadoop(new), hadoop(path), hadoop(_aside(path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    restore_folder(spark, path)
    if files.exists(target) and not files.rename(target, aside):
        raise OSError(f"{path} cannot be replaced.")
    moved = False
    try:
        moved = files.rename(source, target)
    finally:
        if not moved:
            restore_folder(spark, path)
    if not moved:
        raise OSError(f"{new} cannot be moved to {path}.")
    files.delete(aside, True)


def restore_folder(spark: SparkSession, path: str) -> None:
    """Bring back what a replacement that was killed between its two renames had put aside."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = hadoop(path), hadoop(_aside(path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(aside):
        if files.exists(target):  # the new one had arrived
            files.delete(aside, True)
        elif not files.rename(aside, target):
            raise OSError(f"{path} cannot be restored.")


def _aside(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name}.replaced"


class Scratch:
    """What one operation has written; ``drop`` it once its results are stored elsewhere."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def drop(self) -> None:
        delete_folder(self.spark, self.path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Collect what is written inside the block under one handle of its own.

    Lazy results still read these tables after the block, so nothing is deleted until
    the handle's ``drop`` is called.
    """
    handle = Scratch(spark, f"{_app_dir(spark)}/scope-{uuid.uuid4().hex}")
    token = _scope.set(handle.path)
    try:
        yield handle
    finally:
        _scope.reset(token)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote below the shared folder; call when all results are stored."""
    delete_folder(spark, _app_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where a plan must not be evaluated twice: either because it is dear, or
    because its partition numbers (range partitioning samples) may differ between
    two evaluations. Parquet keeps later column pruning and size estimates.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
