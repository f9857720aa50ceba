"""Split points that cut whole-number keys into ranges of about equal row counts.

Unlike range partitioning by a sample, the points depend on the keys alone, so a second run
makes the same ranges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.operators.ordering import with_running_total
from tuneprep.storage import materialize

MOST_RANGES = 1 << 20


def even_splits(df: DataFrame, key: str, rows: int) -> list[int]:
    """First keys of all ranges but the first, each range about ``rows`` rows, more where that gave over ``MOST_RANGES``.

    Each different key's rows are counted and summed up in key order by Spark; the driver gets one
    number per range, 8 MB at most. A key's rows are never parted.
    """
    keys = df.select(F.col(key).cast("long").alias("_key")).where("_key is not null")
    counts = materialize(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if total <= rows:
        return []
    rows = max(rows, -(-total // MOST_RANGES))
    placed = with_running_total(counts, ["_key"], F.col("_n"), before="_before")
    firsts = placed.groupBy(F.expr(f"_before div {rows}").alias("_range")).agg(F.min("_key").alias("first"))
    return sorted(r["first"] for r in firsts.select("first").collect())[1:]


def range_of(keys: np.ndarray, splits: np.ndarray) -> np.ndarray:
    return np.searchsorted(splits, keys, "right")
