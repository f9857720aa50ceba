"""Scratch tables: one handle for each operation."""

import pytest

from tuneprep.storage import materialize, scratch


def test_operations_are_dropped_independently(spark):
    with scratch(spark) as first:
        a = materialize(spark.range(5), "a")
    with scratch(spark) as second:
        b = materialize(spark.range(7), "b")
    first.drop()
    assert b.count() == 7
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        a.collect()
    second.drop()


def test_the_session_keeps_its_settings(spark):
    before = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    materialize(spark.range(3), "c")
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() == before
