"""Arrow IPC files as a data source: batch, stream and sink.

Reading. A file in the file layout is read in parallel, each task a share of its record
batches; one in the stream layout has no index and is one task's work. Tasks are planned
from file sizes; only tasks open files, and read the buffers of the wanted columns alone. Where
``spark.sql.python.filterPushdown.enabled`` is set, comparisons of text, whole-number
and boolean columns are decided in the reader: of a batch without a match only the compared
columns are read.

Writing. Every task writes files of its own under a hidden folder. The commit moves them
next to the data and then replaces the folder's manifest, which names the files that
count: readers see the old result or the new one, and a job that fails leaves the old one.
One job writes to a folder at a time.

Streaming. Committed files arrive in order of their commit's number, other files in order of their
modification time. An offset holds both, and the names of the files at that very time, so a
restart goes on where the stream stopped. A file put there by hand with an older time is not seen.

Paths go through pyarrow's file systems, so every executor must reach them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

NAME = "tuneprep_arrow"
TASK_BYTES = 128 << 20
MANIFEST = "_manifest.json"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int
    commit: int = 0  # of the manifest that names it; 0: none does


def _hidden(name: str) -> bool:
    return any(part.startswith(("_", ".")) for part in name.split("/"))


def _read_manifest(system: fs.FileSystem, folder: str) -> dict[str, int] | None:
    """Names and commit numbers of the files that count; None where any file does."""
    if system.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_file(f"{folder}/{MANIFEST}") as source:
        return json.loads(source.read())


def list_files(path: str) -> list[File]:
    """The path itself, or the data files below it that count, by path."""
    system, inner = _system(path)
    inner = inner.rstrip("/")
    prefix = path.rstrip("/")[: -len(inner)]
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [File(path, info.size or 0, info.mtime_ns or 0)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    named = {f.path.rpartition("/")[0]: _read_manifest(system, f.path.rpartition("/")[0]) for f in found if f.base_name == MANIFEST}
    files = []
    for f in found:
        if f.type == fs.FileType.File and not _hidden(f.path[len(inner) + 1 :]):
            manifest = named.get(f.path.rpartition("/")[0])
            if manifest is None:
                files.append(File(prefix + f.path, f.size, f.mtime_ns))
            elif f.base_name in manifest:
                files.append(File(prefix + f.path, f.size, f.mtime_ns, manifest[f.base_name]))
    return sorted(files, key=lambda f: f.path)


def _open(source, fields: Sequence[str] | None = None):
    """A reader of an open file, of some columns; only the file layout's reader has a batch count."""
    for layout in (pa.ipc.open_file, pa.ipc.open_stream):
        try:
            source.seek(0)
            reader = layout(source)
        except pa.ArrowInvalid:
            continue
        if fields is None:
            return reader
        wanted = [reader.schema.get_field_index(name) for name in fields]
        if -1 in wanted:
            raise ValueError(f"An Arrow file lacks some of the columns {list(fields)}.")
        source.seek(0)
        return layout(source, options=pa.ipc.IpcReadOptions(included_fields=wanted))
    raise ValueError("Not an Arrow file.")


@dataclass
class Batches(InputPartition):
    """Share ``part`` of ``parts`` of a file's record batches."""

    path: str
    part: int
    parts: int


COMPARISONS = {
    EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal,
}


def _matches(batch: pa.RecordBatch, condition: Filter) -> pa.Array:
    """Which rows satisfy a condition; NULL does not."""
    column = batch.column(condition.attribute[0])
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if isinstance(condition, IsNull):
        return pc.is_null(column)
    if isinstance(condition, IsNotNull):
        return pc.is_valid(column)
    if isinstance(condition, In):
        values = pa.array([value for value in condition.value if value is not None], column.type)
        return pc.and_(pc.is_valid(column), pc.is_in(column, value_set=values))
    if isinstance(condition, StringStartsWith):
        return pc.fill_null(pc.starts_with(column, condition.value), False)
    return pc.fill_null(COMPARISONS[type(condition)](column, pa.scalar(condition.value, column.type)), False)


def _supported(condition: Filter, schema: T.StructType) -> bool:
    kinds = (*COMPARISONS, IsNull, IsNotNull, In, StringStartsWith)
    if not isinstance(condition, kinds) or len(condition.attribute) != 1 or condition.attribute[0] not in schema.names:
        return False
    dtype = schema[condition.attribute[0]].dataType
    return type(dtype) is T.StringType or isinstance(dtype, (T.IntegralType, T.BooleanType))


def _shares(files: Iterable[File], task_bytes: int) -> list[Batches]:
    return [Batches(f.path, part, parts) for f in files for parts in [max(1, -(-f.size // task_bytes))] for part in range(parts)]


def _read(partition: Batches | None, columns: list[str], conditions: Sequence[Filter] = ()) -> Iterator[pa.RecordBatch]:
    if partition is None:  # what a source without partitions is asked for
        return
    compared = list(dict.fromkeys(c.attribute[0] for c in conditions))
    system, inner = _system(partition.path)
    with system.open_input_file(inner) as source, system.open_input_file(inner) as again:
        reader = _open(source, columns)
        count = getattr(reader, "num_record_batches", None)
        if count is None:
            for batch in reader if partition.part == 0 else ():
                yield _plain(_chosen(batch, batch, conditions), columns)
            return
        first, last = (count * k // partition.parts for k in (partition.part, partition.part + 1))
        deciding = _open(again, compared) if compared else None
        for i in range(first, last):
            if deciding is None:
                yield _plain(reader.get_batch(i), columns)
                continue
            seen = deciding.get_batch(i)
            if _chosen(seen, seen, conditions).num_rows:
                yield _plain(_chosen(reader.get_batch(i), seen, conditions), columns)


def _plain(batch: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    """The wanted columns, dictionaries spelled out."""
    found = [batch.column(name) for name in columns]
    return pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in found], columns)


def _chosen(batch: pa.RecordBatch, seen: pa.RecordBatch, conditions: Sequence[Filter]) -> pa.RecordBatch:
    """The rows of ``batch`` for which the columns in ``seen`` satisfy all conditions."""
    for condition in conditions:
        mask = _matches(seen, condition)
        batch, seen = batch.filter(mask), seen.filter(mask)
    return batch


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, task_bytes: int):
        self.path, self.schema, self.task_bytes = path, schema, task_bytes
        self.conditions: list[Filter] = []

    def partitions(self) -> list[Batches]:
        return _shares(list_files(self.path), self.task_bytes)

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema.names, self.conditions)


class DecidingArrowReader(ArrowReader):
    """Takes on the conditions that it can decide."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if _supported(condition, self.schema):
                self.conditions.append(condition)
            else:
                yield condition


class ArrowStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType, task_bytes: int):
        self.path, self.schema, self.task_bytes = path, schema, task_bytes

    def initialOffset(self) -> dict:
        return {"commit": 0, "modified": -1, "at": []}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        loose = [f for f in files if not f.commit]
        modified = max((f.modified for f in loose), default=-1)
        at = sorted(f.path for f in loose if f.modified == modified)
        return {"commit": max((f.commit for f in files), default=0), "modified": modified, "at": at}

    def partitions(self, start: dict, end: dict) -> list[Batches]:
        return _shares((f for f in list_files(self.path) if self._by(f, end) and not self._by(f, start)), self.task_bytes)

    @staticmethod
    def _by(file: File, offset: dict) -> bool:
        """Whether a file had arrived by an offset."""
        if file.commit:
            return file.commit <= offset["commit"]
        return file.modified < offset["modified"] or file.path in offset["at"]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema.names)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""

    def stop(self) -> None:
        """Nothing is held open."""


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        system, inner = _system(f"{self.path}/{self.staging}")
        system.create_dir(inner, recursive=True)  # here only: a task that outlives an aborted job finds no folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        batches = (batch for batch in iterator if batch.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        system, inner = _system(f"{self.path}/{self.staging}")
        with system.open_output_stream(f"{inner}/{name}") as out, pa.ipc.new_file(out, first.schema) as writer:
            writer.write_batch(first)
            for batch in batches:
                writer.write_batch(batch)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _system(self.path)
        before = {f.path.rpartition("/")[2]: f for f in list_files(self.path) if f.path.rpartition("/")[0] == self.path}
        number = 1 + max((_read_manifest(system, inner) or {}).values(), default=0)
        new = [message.name for message in messages if message is not None and message.name is not None]
        for name in new:
            system.move(f"{inner}/{self.staging}/{name}", f"{inner}/{name}")
        kept = {} if self.overwrite else {name: f.commit for name, f in before.items()}
        with system.open_output_stream(f"{inner}/{self.staging}.json") as out:
            out.write(json.dumps(kept | dict.fromkeys(new, number)).encode())
        system.move(f"{inner}/{self.staging}.json", f"{inner}/{MANIFEST}")
        for name in before if self.overwrite else ():
            system.delete_file(f"{inner}/{name}")
        self._drop_staging()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        """Delete this job's folder and what jobs before it may have left."""
        system, inner = _system(self.path)
        for f in system.get_file_info(fs.FileSelector(inner)):
            if f.base_name.startswith("_staging-"):
                system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _task_bytes(self) -> int:
        return int(self.options.get("task_bytes", TASK_BYTES))

    def reader(self, schema: T.StructType) -> ArrowReader:
        kind = DecidingArrowReader if self.options.get("pushdown") == "true" else ArrowReader
        return kind(self.options["path"], schema, self._task_bytes())

    def streamReader(self, schema: T.StructType) -> ArrowStreamReader:
        return ArrowStreamReader(self.options["path"], schema, self._task_bytes())

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], overwrite)


def _schema_of(spark: SparkSession, path: str) -> T.StructType:
    first = next(iter(list_files(path)), None)
    if first is None:
        raise ValueError(f"No Arrow files at {path}.")
    system, inner = _system(first.path)
    with system.open_input_file(inner) as source:
        return spark.createDataFrame(_open(source).schema.empty_table()).schema


def read_arrow(
    spark: SparkSession, path: str, schema: T.StructType | None = None, task_bytes: int = TASK_BYTES, columns: Sequence[str] | None = None
) -> DataFrame:
    """The Arrow files at ``path``; without ``schema`` the first file's schema is taken.

    Only ``columns`` are read, if given. A file is cut into as many tasks as it has ``task_bytes``.
    """
    schema = schema or _schema_of(spark, path)
    if columns is not None:
        schema = T.StructType([schema[name] for name in columns])
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format(NAME).schema(schema).option("task_bytes", task_bytes)
    return reader.option("pushdown", spark.conf.get(PUSHDOWN)).load(path)


def stream_arrow(spark: SparkSession, path: str, schema: T.StructType, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The Arrow files at ``path`` as they arrive; each trigger takes all new ones."""
    spark.dataSource.register(ArrowFiles)
    return spark.readStream.format(NAME).schema(schema).option("task_bytes", task_bytes).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write Arrow files in the file layout, replacing (``overwrite``) or adding to (``append``) those at ``path``."""
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format(NAME).mode(mode).save(path)
