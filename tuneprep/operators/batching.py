"""Fixed-length packing, batch numbers and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.operators.ordering import with_running_total
from tuneprep.storage import materialize

# Fixed value: the sides of a preference pair as column suffixes.
SIDES = ("j", "k")


def pack_wrapped(
    df: DataFrame,
    seq_length: int,
    order_by: Sequence[str],
    ids_col: str = "input_ids",
    group_by: Sequence[str] = (),
    eos_id: int | None = None,
    drop_tail: bool = False,
    blocks: str | None = None,
    head: Sequence[int] = (),
) -> DataFrame:
    """Concatenate id arrays in order and cut blocks of ``seq_length``: (groups, block_id, ids).

    Row ends do not matter, except that ``eos_id`` is appended to every row if given.
    The last block of a group may be short; ``drop_tail`` drops it. ``blocks`` names a
    further column for the number of the group's blocks. ``head`` are ids, fewer than a
    block, that come before all rows (without groups only).

    The input is evaluated once, into a table. Only key and length of a row are
    ordered. The ids then move to the block they belong to, as slices: a row costs as
    many slices as blocks it touches, and a block gathers at most ``seq_length``.
    """
    if seq_length < 1:
        raise ValueError("seq_length must be positive.")
    if head and (group_by or len(head) >= seq_length):
        raise ValueError("A head must be shorter than a block, and there must be no groups.")
    order, groups = list(order_by), list(group_by)
    ids = F.col(ids_col) if eos_id is None else F.concat(F.col(ids_col), F.array(F.lit(eos_id)))
    rows = df.select(*groups, *order, ids.alias("_ids")).withColumn("_length", F.size("_ids"))
    rows = materialize(rows, "packing").where(F.col("_length") > 0)
    placed = with_running_total(rows, order, F.col("_length"), groups, before="_start", total="_total")
    if head:
        placed = placed.withColumns({name: F.col(name) + len(head) for name in ("_start", "_total")})

    length = F.lit(seq_length).cast("bigint")
    end = F.col("_start") + F.col("_length")
    block_start = F.col("block_id") * length
    skipped = F.greatest(block_start - F.col("_start"), F.lit(0).cast("bigint"))
    taken = F.least(block_start + length, end) - F.col("_start") - skipped
    pieces = placed.select(
        *groups,
        "_start",
        "_length",
        "_total",
        "_ids",
        F.explode(
            F.sequence(F.expr(f"_start div {seq_length}"), F.expr(f"(_start + _length - 1) div {seq_length}"))
        ).alias("block_id"),
    ).select(
        *groups,
        "block_id",
        "_total",
        (F.col("_start") + skipped - block_start).cast("int").alias("_at"),
        F.slice("_ids", (skipped + 1).cast("int"), taken.cast("int")).alias("_piece"),
    )
    if head:
        first = [F.lit(0).cast("bigint"), F.lit(len(head)).cast("bigint"), F.lit(0), F.array(*map(F.lit, head)).cast("array<int>")]
        pieces = pieces.union(df.sparkSession.range(1, numPartitions=1).select(*first))
    in_order = F.array_sort(F.collect_list(F.struct("_at", "_piece")))
    last_block = F.expr(f"(_total - {seq_length if drop_tail else 1}) div {seq_length}")
    counted = [] if blocks is None else [F.max(last_block + 1).alias(blocks)]
    packed = pieces.groupBy(*groups, "block_id").agg(
        F.flatten(F.transform(in_order, lambda piece: piece["_piece"])).alias("input_ids"), *counted
    )
    return packed.where(F.size("input_ids") == seq_length) if drop_tail else packed


def assign_batches(
    df: DataFrame,
    batch_size: int,
    order_by: Sequence[str] = (),
    position: str | None = None,
    rows: str | None = None,
    group_by: Sequence[str] = (),
    accumulation: int = 1,
    drop_last: bool = False,
) -> DataFrame:
    """Add ``batch_id``: consecutive runs of ``batch_size * accumulation`` rows in order.

    Rows are numbered by ``order_by``, or already carry a gapless ``position`` from 0
    (such as the block number of :func:`pack_wrapped`). ``drop_last`` drops a last
    batch that is not full; with a given position, ``rows`` may name a column with the
    number of the group's rows, which are counted otherwise.
    """
    step = batch_size * max(1, accumulation)
    groups = list(group_by)
    if step < 1:
        raise ValueError("batch_size must be positive.")
    if position is None:
        numbered = with_running_total(df, order_by, None, groups, before="_position", total="_rows")
    else:
        numbered = df.withColumn("_position", F.col(position))
        if rows is not None:
            numbered = numbered.withColumn("_rows", F.col(rows))
        elif drop_last:
            numbered = _with_group_rows(numbered, groups, step)
    batched = numbered.withColumn("batch_id", F.expr(f"_position div {step}"))
    if drop_last:
        batched = batched.where(F.col("batch_id") < F.expr(f"_rows div {step}"))
    return batched.drop("_position", "_rows")


def _with_group_rows(numbered: DataFrame, groups: list[str], step: int) -> DataFrame:
    """Add ``_rows``, the group's size, as far as the last full batch depends on it.

    Each batch is counted by itself: a group may be large, a batch never is.
    """
    batch = F.expr(f"_position div {step}")
    in_batch = Window.partitionBy(*groups, batch)
    return numbered.withColumn("_rows", batch * step + F.count(F.lit(1)).over(in_batch))


def pad_to(ids: Column, length: Column, value: int, side: str = "right") -> Column:
    """An array filled up to ``length``; longer arrays stay as they are."""
    missing = F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(ids, missing) if side == "right" else F.concat(missing, ids)


def collate_pairs(
    df: DataFrame,
    pad_id: int,
    batch: Sequence[str] = ("batch_id",),
    padding: bool | str = True,
    max_length: int | None = None,
    pad_to_multiple_of: int | None = None,
    padding_side: str = "right",
) -> DataFrame:
    """Pad both sides of every batch, each side to its own longest row; add ``return_loss``.

    ``padding`` is True or ``"longest"``, ``"max_length"``, or False. Masks are padded
    with 0. ``max_length`` plays no part under longest-padding.
    """
    if padding_side not in ("right", "left"):
        raise ValueError("padding_side must be right or left.")
    sizes = {side: F.size(f"input_ids_{side}") for side in SIDES}
    longest, lengths = {}, {}
    for side in SIDES:
        if padding is True or padding == "longest":
            longest[f"_length_{side}"] = F.max(sizes[side]).over(Window.partitionBy(*batch))
            lengths[side] = F.col(f"_length_{side}")
        elif padding == "max_length":
            if max_length is None:
                raise ValueError("max_length padding needs max_length.")
            lengths[side] = F.lit(max_length)
        elif padding is not False and padding != "do_not_pad":
            raise ValueError(f"Unknown padding: {padding!r}")
    out = df.withColumns(longest) if longest else df
    for side, length in lengths.items():
        if pad_to_multiple_of:
            length = (F.ceil(length / pad_to_multiple_of) * pad_to_multiple_of).cast("int")
        out = out.withColumns(
            {
                f"input_ids_{side}": pad_to(F.col(f"input_ids_{side}"), length, pad_id, padding_side),
                f"attention_mask_{side}": pad_to(F.col(f"attention_mask_{side}"), length, 0, padding_side),
            }
        )
    return out.drop(*longest).withColumn("return_loss", F.lit(True))
