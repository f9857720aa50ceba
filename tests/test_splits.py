import hashlib

import pytest
from pyspark.sql import functions as F

from tuneprep.operators.splits import exact_split, split_sizes, train_test


def numbers(spark, rows):
    return spark.range(rows).withColumn("part", F.lit("x"))


@pytest.mark.parametrize("rows, size, test", [(2, 4000, 1), (10, 0, 1), (10, -5, 1), (10, 3, 3), (10, 10, 9), (300, 137, 137)])
def test_sizes_are_exact(spark, rows, size, test):
    marked = exact_split(numbers(spark, rows), size, 0, ["id"])
    assert {r.split: r.rows for r in split_sizes(marked).collect()} == {"test": test, "train": rows - test}


def test_members(spark):
    df = numbers(spark, 200)
    order = sorted(range(200), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    for part in (df.coalesce(1), df.repartition(6)):
        train, test = train_test(part, 30, 5, ["id"])
        assert {r.id for r in test.collect()} == set(order[:30])
        assert {r.id for r in train.collect()} == set(order[30:])
        shuffled = [r.id for r in train.orderBy("split_hash", "id").collect()]
        assert shuffled == order[30:]
    other = {r.id for r in train_test(df, 30, 6, ["id"])[1].collect()}
    assert other != set(order[:30])


@pytest.mark.parametrize("rows", [0, 1])
def test_too_small(spark, rows):
    with pytest.raises(ValueError, match="at least 2"):
        exact_split(numbers(spark, rows), 1, 0, ["id"])


def test_existing_columns_are_kept(spark):
    with pytest.raises(ValueError, match="Rename"):
        exact_split(numbers(spark, 9).withColumn("split", F.lit("mine")), 2, 0, ["id"])


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError, match="identify"):
        exact_split(numbers(spark, 9).union(numbers(spark, 1)), 2, 0, ["id"])
