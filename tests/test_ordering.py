"""Positions, running totals and ordered limits against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tuneprep.operators.ordering import OrderedKeys, first_n, nth_key, with_running_total


@pytest.fixture
def many_parts(spark):
    """Range partitioning over several parts even for small tables."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def keyed(spark, rows=500, seed=1):
    """Rows as (group, a, b, amount); one group holds a third of them."""
    rng = random.Random(seed)
    keys = rng.sample([(a, b) for a in range(-40, 40) for b in "abcdefghijklmnop"], rows)
    groups = [rng.choice(["hot", "hot", "x", "y", "z", "w"]) for _ in keys]
    data = [(g, a, b, rng.randrange(0, 9)) for g, (a, b) in zip(groups, keys)]
    return data, spark.createDataFrame(data, "g string, a int, b string, amount int").repartition(5)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("grouped", [False, True])
def test_running_totals(spark, many_parts, weighted, grouped):
    data, df = keyed(spark)
    value = F.col("amount") if weighted else None
    out = with_running_total(df, ["a", "b"], value, ["g"] if grouped else [], before="before", total="total")
    assert out.count() == len(data)
    expected, totals = {}, {}
    for g, a, b, amount in sorted(data, key=lambda row: row[1:3]):
        group = g if grouped else ""
        expected[a, b] = totals.get(group, 0)
        totals[group] = totals.get(group, 0) + (amount if weighted else 1)
    for row in out.collect():
        assert row.before == expected[row.a, row.b]
        assert row.total == totals[row.g if grouped else ""]


def test_positions_do_not_depend_on_partitions(spark, many_parts):
    _, df = keyed(spark)
    orders = [
        sorted((r.a, r.b, r.rows_before) for r in with_running_total(part, ["a", "b"]).collect())
        for part in (df.coalesce(1), df.repartition(7), df.repartition(3, "g"))
    ]
    assert orders[0] == orders[1] == orders[2]


@pytest.mark.parametrize("weighted", [False, True])
def test_unusable_order_is_refused(spark, weighted):
    value = F.lit(2) if weighted else None
    repeated = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(Exception, match="must identify each row"):
        with_running_total(repeated, ["k"], value).collect()
    missing = spark.createDataFrame([(1,), (None,)], "k int")
    with pytest.raises(Exception, match="must not be NULL"):
        with_running_total(missing, ["k"], value).collect()
    with pytest.raises(ValueError):
        with_running_total(repeated, [], value)


@pytest.mark.parametrize("n", [0, -1, None, 1, 7, 100, 499, 500, 501])
def test_first_n(spark, n):
    data, df = keyed(spark)
    expected = sorted(row[1:3] for row in data)
    if n is not None and n > 0:
        expected = expected[:n]
    assert sorted((r.a, r.b) for r in first_n(df, n, ["a", "b"]).collect()) == expected


@pytest.mark.parametrize("n", [1, 5, 40, 300, 499])
def test_nth_key_over_several_ranges(spark, many_parts, n):
    data, df = keyed(spark)
    row = nth_key(df, ["a", "b"], n)
    assert (row.a, row.b) == sorted(row[1:3] for row in data)[n - 1]


@pytest.mark.parametrize("n", [1, 40, 499, 500, 900])
def test_first_keys_with_positions(spark, many_parts, n):
    data, df = keyed(spark)
    keys = OrderedKeys(df, ["a", "b"]).first(n)
    expected = [(a, b, i) for i, (a, b) in enumerate(sorted(row[1:3] for row in data)[:n])]
    assert sorted((r.a, r.b, r.position) for r in keys.collect()) == expected
    assert OrderedKeys(df.limit(0), ["a", "b"]).first(n).collect() == []


def test_looking_a_key_up_sorts_nothing(spark, many_parts):
    keys = OrderedKeys(keyed(spark)[1], ["a", "b"])
    plan = keys.first(7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_slot), LessThanOrEqual(_slot" in plan and "Sort [a" not in plan


def test_nth_key_evaluates_its_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = spark.range(1000).mapInArrow(count, "id long")
    assert nth_key(counted, ["id"], 400).id == 399
    assert seen.value <= 2000


def test_first_n_refuses_unusable_keys(spark):
    repeated = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    for n in (1, 2, 3):  # wherever the cut lies
        with pytest.raises(ValueError, match="identify"):
            first_n(repeated, n, ["k"])
    with pytest.raises(ValueError, match="NULL"):
        first_n(spark.createDataFrame([(1,), (None,)], "k int"), 1, ["k"])


def test_first_n_reaches_the_scan(spark, out_dir):
    spark.range(1000).write.parquet(out_dir)
    cut = first_n(spark.read.parquet(out_dir), 10, ["id"])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,9)" in plan and "Sort" not in plan


@pytest.mark.parametrize("dtype, values", [
    ("timestamp_ntz", "timestamp_ntz'2024-01-01 00:00:00.123456' + make_dt_interval(0, 0, 0, id * 1.5)"),
    ("decimal(20,4)", "id / 7"),
    ("date", "date_add(date'2024-01-01', cast(id as int))"),
    ("double", "id / 7"),
])
def test_first_n_by_other_types(spark, dtype, values):
    df = spark.range(50).select(F.expr(f"cast({values} as {dtype})").alias("k"), "id")
    assert {r.id for r in first_n(df, 17, ["k", "id"]).collect()} == set(range(17))
