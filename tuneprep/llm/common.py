"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.llm.words import slices


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id's text leaves no remainder. NULL ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


# Small enough that the arrays made for a slice stay in tens of MB.
APPEND_BYTES = 1 << 20


def _append(batches: Iterator[pa.RecordBatch], text: str, compute: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, text, APPEND_BYTES):
            yield pa.RecordBatch.from_arrays([*cut.columns, *compute(cut)], [*cut.schema.names, *names])


def free_name(df: DataFrame, name: str, others: tuple[str, ...] = ()) -> str:
    """``name``, lengthened until no column, and none of ``others``, is called so."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], compute: Callable) -> DataFrame:
    """All columns of ``df`` and new ones that ``compute`` makes from each slice of rows, about a MB of text at a time.

    A column that has the name of a new one gets underscores before it.
    """
    names = [f.name for f in fields]
    for column in df.columns:
        if column.lower() in {name.lower() for name in names}:
            df = df.withColumnRenamed(column, free_name(df, column, tuple(names)))
    schema = T.StructType([*df.schema.fields, *fields])
    return df.mapInArrow(lambda batches: _append(batches, text, compute, names), schema)
