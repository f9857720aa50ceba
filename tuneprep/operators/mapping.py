"""Caller-supplied functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    num_proc: int | None = None,
) -> DataFrame:
    """Apply ``fn`` to Arrow batches of rows; only columns it returns are kept.

    ``num_proc`` is accepted as a hint and changes nothing: the partitions there are run
    in parallel anyway, and dealing rows to fewer would only slow them down.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
