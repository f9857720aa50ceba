import random

import pytest
from pyspark.sql import functions as F

from tuneprep.operators.batching import assign_batches, collate_pairs, pack_wrapped

SCHEMA = "g string, k int, input_ids array<int>"


def cut(rows, length, eos, drop):
    stream = [i for row in rows for i in row + ([eos] if eos is not None else [])]
    blocks = [stream[i : i + length] for i in range(0, len(stream), length)]
    return [block for block in blocks if len(block) == length or not drop]


LENGTHS = [[4, 4], [3], [1, 14, 2], [0, 5, 0], [12], [2, 2, 2, 2], [0], [40, 1]]


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("eos, drop", [(None, False), (None, True), (99, False)])
def test_packing_edges(spark, grouped, eos, drop):
    """Every case as a group of its own, then all of them as one stream."""
    counter = iter(range(1000))
    cases = {str(i): [[next(counter) for _ in range(n)] for n in lengths] for i, lengths in enumerate(LENGTHS)}
    data = [(case, 100 * int(case) + k, row) for case, rows in cases.items() for k, row in enumerate(rows)]
    if not grouped:
        cases = {"all": [row for rows in cases.values() for row in rows]}
    out = pack_wrapped(
        spark.createDataFrame(data, SCHEMA), 4, ["k"], group_by=["g"] * grouped, eos_id=eos, drop_tail=drop, blocks="n"
    ).collect()
    for case, rows in cases.items():
        part = [r for r in out if not grouped or r.g == case]
        expected = cut(rows, 4, eos, drop)
        blocks = {r.block_id: r.input_ids for r in part}
        assert [blocks[i] for i in range(len(blocks))] == expected
        assert {r.n for r in part} == ({len(expected)} if expected else set())


@pytest.mark.parametrize("length", [1, 7, 64])
def test_packing_random_rows_by_group(spark, length):
    """One group has most rows, one row is longer than all others together."""
    rng = random.Random(length)
    data = [(rng.choice("aaab"), k, [rng.randrange(50) for _ in range(rng.randrange(0, 12))]) for k in range(300)]
    data[17] = ("a", 17, list(range(2000)))
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    out = pack_wrapped(df, length, ["k"], group_by=["g"]).collect()
    for group in "ab":
        blocks = {r.block_id: r.input_ids for r in out if r.g == group}
        rows = [row for g, _, row in sorted(data, key=lambda r: r[1]) if g == group]
        assert [blocks[i] for i in range(len(blocks))] == cut(rows, length, None, False)


def test_packing_needs_a_length(spark):
    with pytest.raises(ValueError):
        pack_wrapped(spark.createDataFrame([], SCHEMA), 0, ["k"])


@pytest.mark.parametrize("rows, drop, kept", [(3, True, 0), (3, False, 3), (8, True, 8), (9, True, 8), (9, False, 9)])
def test_batches(spark, rows, drop, kept):
    df = spark.range(rows).select((F.col("id") * 10).alias("k"))
    out = assign_batches(df, 2, ["k"], accumulation=2, drop_last=drop)
    assert {(r.k, r.batch_id) for r in out.collect()} == {(10 * i, i // 4) for i in range(kept)}
    told = assign_batches(spark.range(rows).withColumn("n", F.lit(rows)), 4, position="id", rows="n", drop_last=drop)
    assert {(r.id, r.batch_id) for r in told.collect()} == {(i, i // 4) for i in range(kept)}
    given = assign_batches(spark.range(rows), 4, position="id", drop_last=drop)
    assert {(r.id, r.batch_id) for r in given.collect()} == {(i, i // 4) for i in range(kept)}


def test_batches_of_given_positions_by_group(spark):
    data = [("a", i) for i in range(11)] + [("b", i) for i in range(8)] + [("c", 0)]
    df = spark.createDataFrame(data, "g string, block_id long")
    out = assign_batches(df, 4, position="block_id", group_by=["g"], drop_last=True)
    full = {"a": 8, "b": 8, "c": 0}
    assert {tuple(r) for r in out.select("g", "block_id", "batch_id").collect()} == {
        (g, i, i // 4) for g, n in full.items() for i in range(n)
    }


PAIR = "batch_id int, k int, input_ids_j array<int>, attention_mask_j array<int>, input_ids_k array<int>, attention_mask_k array<int>"
PAIRS = [
    (0, 1, [5, 6, 7], [1, 1, 1], [5], [1]),
    (0, 2, [8], [1], [5, 9, 9, 9, 9], [1, 1, 1, 1, 1]),
    (1, 3, [2], [1], [2, 2], [1, 1]),
]


def collated(spark, **options):
    out = collate_pairs(spark.createDataFrame(PAIRS, PAIR), 2, **options)
    return {r.k: r for r in out.collect()}


def test_each_side_is_padded_to_its_own_longest_row(spark):
    rows = collated(spark)
    assert rows[2].input_ids_j == [8, 2, 2] and rows[2].attention_mask_j == [1, 0, 0]
    assert rows[1].input_ids_k == [5, 2, 2, 2, 2] and rows[1].attention_mask_k == [1, 0, 0, 0, 0]
    # The padding id occurs in the text too: only the mask tells them apart.
    assert rows[3].input_ids_j == [2] and rows[3].attention_mask_j == [1]
    assert all(r.return_loss is True for r in rows.values())
    assert sum(sum(r.attention_mask_j) for r in rows.values()) == 5


def test_other_paddings(spark):
    assert {len(r.input_ids_k) for r in collated(spark, pad_to_multiple_of=8).values()} == {8}
    assert {len(r.input_ids_j) for r in collated(spark, padding="max_length", max_length=6).values()} == {6}
    assert collated(spark, padding=False)[2].input_ids_j == [8]
    assert collated(spark, max_length=1)[1].input_ids_j == [5, 6, 7]
    assert collated(spark, padding_side="left")[2].attention_mask_j == [0, 0, 1]
    for bad in ({"padding": "max_length"}, {"padding": "odd"}, {"padding_side": "top"}):
        with pytest.raises(ValueError):
            collated(spark, **bad)
