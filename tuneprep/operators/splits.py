"""Exact, seeded train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.operators.ordering import OrderedKeys, up_to

SPLIT = "split"
SPLIT_HASH = "split_hash"


def split_hash(seed: int, key: Sequence[str]) -> Column:
    """The shuffled order of a split: rows sort by this hash of seed and key."""
    parts = [F.lit(str(seed))]
    for name in key:
        parts += [F.lit(":"), F.col(name).cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def exact_split(df: DataFrame, size: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Add ``split`` (``train``/``test``) and ``split_hash``, the shuffled order.

    Exactly ``max(1, min(size, rows - 1))`` rows become ``test``: those with the
    smallest (hash, key). The same seed and keys give the same members whatever the
    partitioning. Each part's order for later steps is ``split_hash`` then ``key``.
    A table that has columns of these names already is refused.
    """
    key = [key] if isinstance(key, str) else list(key)
    taken = {SPLIT, SPLIT_HASH} & set(df.columns)
    if taken:
        raise ValueError(f"Rename the columns {sorted(taken)}: a split adds columns of that name.")
    hashed = df.withColumn(SPLIT_HASH, split_hash(seed, key))
    order = [SPLIT_HASH, *key]
    keys = OrderedKeys(hashed, order)
    if keys.rows < 2:
        raise ValueError("A train/test split needs at least 2 rows.")
    last = keys.nth(max(1, min(size, keys.rows - 1)))
    is_test = up_to(hashed, order, last)
    return hashed.withColumn(SPLIT, F.when(is_test, "test").otherwise("train"))


def train_test(df: DataFrame, size: int, seed: int, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The two parts of :func:`exact_split` as (train, test)."""
    marked = exact_split(df, size, seed, key)
    return tuple(marked.where(F.col(SPLIT) == part).drop(SPLIT) for part in ("train", "test"))


def split_sizes(marked: DataFrame) -> DataFrame:
    """Rows per split."""
    return marked.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("rows"))
