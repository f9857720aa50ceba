"""Preference metrics and weighted shares: plain aggregates, partial before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.operators.ordering import with_running_total

REWARD_J, REWARD_K = "rewards_j", "rewards_k"


def accuracy(rewards_j: Column, rewards_k: Column) -> Column:
    """Mean of ``j > k``: ties, NaN and NULL count as wrong; NULL over no rows."""
    j, k = rewards_j.cast("double"), rewards_k.cast("double")
    # Spark sorts NaN above all numbers; a comparison with it must be false here.
    return F.avg(F.when(~F.isnan(j) & ~F.isnan(k) & (j > k), 1.0).otherwise(0.0))


def logloss(rewards_j: Column, rewards_k: Column) -> Column:
    """Mean of ``-log(sigmoid(j - k))``, stable for any margin; NaN if any pair holds NaN or NULL."""
    margin = rewards_j.cast("double") - rewards_k.cast("double")
    stable = F.greatest(F.lit(0.0), -margin) + F.log1p(F.exp(-F.abs(margin)))
    return F.avg(F.when(margin.isNull() | F.isnan(margin), F.lit(float("nan"))).otherwise(stable))


def pairwise_accuracy(
    df: DataFrame, rewards_j: str = REWARD_J, rewards_k: str = REWARD_K, group_by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*group_by).agg(accuracy(F.col(rewards_j), F.col(rewards_k)).alias("accuracy"))


def pairwise_logloss(
    df: DataFrame, rewards_j: str = REWARD_J, rewards_k: str = REWARD_K, group_by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*group_by).agg(logloss(F.col(rewards_j), F.col(rewards_k)).alias("loss"))


def scores_from_struct(df: DataFrame, column: str) -> DataFrame | None:
    """A named pair of scores per row; None if either name is missing."""
    names = df.schema[column].dataType.names
    if REWARD_J not in names or REWARD_K not in names:
        return None
    return df.select(f"{column}.{REWARD_J}", f"{column}.{REWARD_K}")


def scores_from_arrays(df: DataFrame, array_j: str, array_k: str) -> DataFrame:
    """A pair of score vectors per row, each cut to the shorter one."""
    size = F.least(F.size(array_j), F.size(array_k))
    pairs = F.arrays_zip(
        F.slice(array_j, F.lit(1), size).alias(REWARD_J), F.slice(array_k, F.lit(1), size).alias(REWARD_K)
    )
    return df.where(size > 0).select(F.inline(pairs).alias(REWARD_J, REWARD_K))


def scores_from_matrix(df: DataFrame, row: str, column: str, value: str) -> DataFrame | None:
    """A matrix of cells (row, column, value), two rows or two columns; None for other shapes.

    Two rows are tried first, so a 2x2 matrix holds one score vector per row. A cell that
    is missing or given twice fails the job; a NULL value is a score.
    """
    rows, columns = df.agg(F.max(row) + 1, F.max(column) + 1).first()
    if rows == 2:
        side, position = row, column
    elif columns == 2:
        side, position = column, row
    else:
        return None
    cells = df.groupBy(position).agg(
        F.max(F.when(F.col(side) == 0, F.col(value))).alias(REWARD_J),
        F.max(F.when(F.col(side) == 1, F.col(value))).alias(REWARD_K),
        F.count_if(F.col(side) == 0).alias("_cells_j"),
        F.count_if(F.col(side) == 1).alias("_cells_k"),
    )
    whole = (F.col("_cells_j") == 1) & (F.col("_cells_k") == 1)
    wrong = F.raise_error(F.lit("A score matrix needs each cell exactly once."))
    return cells.select(F.when(whole, F.col(REWARD_J)).otherwise(wrong).alias(REWARD_J), REWARD_K)


def align_scores(
    scores_j: DataFrame, scores_k: DataFrame, value: str, order_by: Sequence[str]
) -> DataFrame:
    """Pair two score tables by position in order, down to the shorter one."""

    def numbered(scores: DataFrame, name: str) -> DataFrame:
        placed = with_running_total(scores.select(*order_by, value), order_by, before="position")
        return placed.select("position", F.col(value).alias(name))

    return numbered(scores_j, REWARD_J).join(numbered(scores_k, REWARD_K), "position")


def flagged_share(df: DataFrame, amount: str, flag: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Flagged amount, whole amount and the percentage between them (NULL of nothing)."""
    flagged = F.sum(F.when(F.col(flag), F.col(amount)).otherwise(0))
    whole = F.sum(amount)
    return df.groupBy(*group_by).agg(
        flagged.alias("flagged"),
        whole.alias("total"),
        F.try_divide(F.lit(100.0) * flagged, whole).alias("percent"),
    )
