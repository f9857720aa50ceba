"""Reading named splits of a dataset, in batch or as a stream, and writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.sources.arrow_files import read_arrow, stream_arrow, write_arrow
from tuneprep.storage import delete_folder, replace_folder

# The usual folders of a local dataset and the final result folder.
LAYOUT = {"sft": "finetune", "reward_train": "reward", "reward_eval": "evaluation", "prompts": "rl"}
FINAL = "final"
FORMATS = ("parquet", "json", "arrow")


def split_path(base: str, split: str | None = None, data_dir: str = "") -> str:
    """``base[/data_dir][/split]``; empty parts are left out."""
    if not base:
        raise ValueError("Name a dataset to read.")
    return "/".join(part.rstrip("/") for part in (base, data_dir, split) if part)


def layout_path(root: str, stage: str) -> str:
    """The folder of one stage's data below the root of a local dataset."""
    if stage not in LAYOUT:
        raise ValueError(f"Unknown stage {stage!r}: expected one of {', '.join(LAYOUT)}.")
    return split_path(root, None, LAYOUT[stage])


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format {fmt!r}: expected one of {', '.join(FORMATS)}.")


def read_split(
    spark: SparkSession,
    base: str,
    split: str | None = None,
    data_dir: str = "",
    fmt: str = "parquet",
    split_column: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One named split: a sub-folder, or the rows of one value of ``split_column``.

    A split column's rows are chosen by a filter that reaches the scan: as partition
    pruning where the dataset is partitioned by it, else as a pushed-down predicate.
    Arrow files decide it in their reader where the session lets Python sources take filters.
    """
    _check_format(fmt)
    if split_column is not None and split is None:
        raise ValueError("Name the split to read from the split column.")
    path = split_path(base, split if split_column is None else None, data_dir)
    if fmt == "arrow":
        df = read_arrow(spark, path, schema)
    else:
        reader = spark.read.format(fmt)
        df = (reader if schema is None else reader.schema(schema)).load(path)
    return df if split_column is None else df.where(F.col(split_column) == split).drop(split_column)


def read_train_eval(
    spark: SparkSession, base: str, train_split: str = "train_prefs", eval_split: str = "test_prefs", **options
) -> tuple[DataFrame, DataFrame]:
    """Two splits of one dataset, as (train, eval); options as in :func:`read_split`."""
    return read_split(spark, base, train_split, **options), read_split(spark, base, eval_split, **options)


def read_stream(
    spark: SparkSession,
    base: str,
    schema: T.StructType,
    split: str | None = None,
    data_dir: str = "",
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """One named split as a stream of files in order of arrival."""
    _check_format(fmt)
    if fmt == "arrow":
        if max_files_per_trigger is not None:
            raise ValueError("A stream of Arrow files takes all new files at each trigger.")
        return stream_arrow(spark, split_path(base, split, data_dir), schema)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(split_path(base, split, data_dir))


def write_prepared(df: DataFrame, out: str, name: str = FINAL, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write a result to its fixed place below ``out``, replacing an earlier one; return the path.

    The new result is written aside, complete, and then takes the earlier one's place by
    renames: a job that fails leaves the earlier one readable, and a result may be made
    from the one that it replaces. Killed between the two renames, the earlier one waits as
    ``_<name>.replaced`` and the next write brings it back first. One job writes to a place
    at a time.
    """
    if not out:
        raise ValueError("Name an output folder.")
    _check_format(fmt)
    path = f"{out.rstrip('/')}/{name}"
    if fmt == "arrow":
        if partition_by:
            raise ValueError("Arrow files are not written by partition.")
        write_arrow(df, path)
        return path
    folder, _, leaf = path.rpartition("/")
    new = f"{folder}/_{leaf}.{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).format(fmt).save(new)
        replace_folder(df.sparkSession, new, path)
    except Exception:
        delete_folder(df.sparkSession, new)
        raise
    return path
