"""Row order without a single-task sort.

Spark rows have no order of their own, so every positional operator takes
``order_by``: column names whose values are never NULL and identify a row. Both
rules are checked while the job runs. Only those key columns are sorted or
numbered; wide columns are joined back by key or cut off with a filter, so they
are never sorted and never pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.storage import materialize

def _any_null(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).isNull() for name in names])


def _require_order(order_by: Sequence[str]) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by must name at least one column: Spark rows have no order of their own.")
    return names


def with_running_total(
    df: DataFrame,
    order_by: Sequence[str],
    value: Column | None = None,
    group_by: Sequence[str] = (),
    before: str = "rows_before",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same group.

    Without ``value`` that is the row's position, from 0. ``total`` names a further
    column for the group's whole sum.

    The keys are range-partitioned on (group, order), so one hot group spreads over
    many partitions; each partition is summed by itself and shifted by the sums of
    the partitions before it (one row per partition and group). The partition
    numbers come from sampled ranges, hence the written table between the steps.
    """
    order, groups = _require_order(order_by), list(group_by)
    keys = [*groups, *order]
    slots, sums = _row_numbers(df, groups, order) if value is None else _running_sums(df, groups, order, value)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier_parts = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        "_part",
        *groups,
        (F.coalesce(F.sum("_sum").over(earlier_parts), F.lit(0)) - F.col("_base")).alias("_shift"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    if not groups:  # one row per partition number
        shifts = F.broadcast(shifts)

    # Grouping by the join keys costs no shuffle of its own and finds repeated keys.
    positions = (
        slots.join(shifts, on=["_part", *groups])
        .groupBy(*keys)
        .agg(
            F.min(F.col("_shift") + F.col("_earlier")).alias("_before"),
            F.min("_total").alias("_total"),
            F.count(F.lit(1)).alias("_copies"),
        )
    )
    unique = F.when(
        F.col("_copies") > 1, F.raise_error(F.lit("order_by must identify each row, but some keys repeat."))
    )
    added = [unique.otherwise(F.col("_before")).alias(before)]
    if total is not None:
        added.append(F.col("_total").alias(total))
    return df.join(positions.select(*keys, *added), on=keys)


def _checked(keys: Sequence[str], amount: Column) -> Column:
    nulls = F.raise_error(F.lit("Order and group columns must not be NULL."))
    return F.when(_any_null(keys), nulls).otherwise(amount.cast("bigint")).alias("_amount")


def _row_numbers(df: DataFrame, groups: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys with ``_part`` and the number of earlier rows in that part; rows per part and group.

    A sorted partition's generated ids hold both, so nothing is shuffled again.
    They count on from one group to the next, hence each group's own ``_base``.
    """
    keys = [*groups, *order]
    slots = materialize(
        df.select(*keys, _checked(keys, F.lit(1)))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "slots",
    ).select(
        *keys,
        F.col("_amount"),
        F.shiftright("_slot", 33).alias("_part"),
        F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)).alias("_earlier"),
    )
    sums = slots.groupBy("_part", *groups).agg(F.sum("_amount").alias("_sum"), F.min("_earlier").alias("_base"))
    return slots, sums


def _running_sums(
    df: DataFrame, groups: list[str], order: list[str], value: Column
) -> tuple[DataFrame, DataFrame]:
    """Keys with ``_part`` and the sum over earlier rows of that part and group; sums of those."""
    keys = [*groups, *order]
    slots = materialize(
        df.select(*keys, _checked(keys, value))
        .repartitionByRange(*keys)
        .withColumn("_part", F.spark_partition_id()),
        "slots",
    )
    sums = slots.groupBy("_part", *groups).agg(F.sum("_amount").alias("_sum"), F.lit(0).alias("_base"))
    earlier = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("_earlier", F.coalesce(F.sum("_amount").over(earlier), F.lit(0))), sums


def _typed(row: Row, df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.lit(row[name]).cast(df.schema[name].dataType).alias(name) for name in names]


def up_to(df: DataFrame, order_by: Sequence[str], row: Row) -> Column:
    """Predicate: the row's key is at or before ``row``'s key.

    The leading column is compared on its own as well, which readers can push down.
    """
    bound = _typed(row, df, order_by)
    first = F.col(order_by[0]) <= bound[0]
    if len(order_by) == 1:
        return first
    return first & (F.struct(*order_by) <= F.struct(*bound))


class OrderedKeys:
    """A table's order keys, written once in sorted ranges: an index of positions.

    The input is evaluated to sample the ranges and to write (keys, slot), never again.
    A slot holds the range and the place in it, so slots rise in key order, and the counts
    of the ranges turn a position into a slot: a look-up reads one row and sorts nothing.
    NULL keys and repeated keys are refused; equal keys share a range, so counting their
    copies needs no further shuffle. ``unique`` says that keys cannot repeat, such as those
    of a grouping.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str], unique: bool = False):
        self.order = _require_order(order_by)
        ranged = df.select(*self.order).repartitionByRange(*self.order)
        copies = F.count(F.lit(1)).alias("_copies")
        ranged = ranged.withColumn("_copies", F.lit(1)) if unique else ranged.groupBy(*self.order).agg(copies)
        slots = ranged.sortWithinPartitions(*self.order).withColumn("_slot", F.monotonically_increasing_id())
        self.keys = materialize(slots, "order-keys")
        self.parts = self.keys.groupBy(F.shiftright("_slot", 33).alias("_part")).agg(
            F.sum("_copies").alias("rows"),
            F.count_if(_any_null(self.order)).alias("nulls"),
            F.max("_copies").alias("copies"),
        )
        totals = self.parts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.sum("nulls"), F.max("copies"))
        self.rows, missing, most = totals.first()
        if missing:
            raise ValueError("Order columns must not be NULL.")
        if (most or 0) > 1:
            raise ValueError("order_by must identify each row, but some keys repeat.")

    def _ranges(self) -> DataFrame:
        """Each range with the number of rows ``before`` it; one row per range."""
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        return self.parts.select("_part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))

    def _slot(self, n: int) -> int | None:
        """The slot of the ``n``-th key (from 1); None if there are no more than ``n`` rows."""
        if n >= self.rows:
            return None
        part = self._ranges().where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n)).first()
        return (part["_part"] << 33) + n - 1 - part["before"]

    def nth(self, n: int) -> Row | None:
        """The ``n``-th key (from 1); None if there are no more than ``n`` rows."""
        slot = self._slot(n)
        return None if slot is None else self.keys.where(F.col("_slot") == slot).select(*self.order).first()

    def first(self, n: int, position: str = "position") -> DataFrame:
        """The first ``n`` keys and their position, from 0. The cut reaches the scan of the written keys."""
        slot = self._slot(n)
        keys = self.keys if slot is None else self.keys.where(F.col("_slot") <= slot)
        shift = F.broadcast(self._ranges().select("_part", "before"))
        place = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
        placed = keys.withColumn("_part", F.shiftright("_slot", 33)).join(shift, "_part")
        return placed.select(*self.order, place.alias(position))


def nth_key(df: DataFrame, order_by: Sequence[str], n: int) -> Row | None:
    """Key of the ``n``-th row (from 1) in order; None if there are no more than ``n`` rows."""
    return OrderedKeys(df, order_by).nth(n)


def first_n(df: DataFrame, n: int | None, order_by: Sequence[str]) -> DataFrame:
    """The first ``min(n, rows)`` rows in order; all rows if ``n`` is None or not positive.

    Finds the last wanted key and filters, so rows stay where they are and the cut
    reaches the scan, whatever ``n`` is.
    """
    if n is None or n <= 0:
        return df
    order = _require_order(order_by)
    row = nth_key(df, order, n)
    return df if row is None else df.where(up_to(df, order, row))
