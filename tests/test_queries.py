"""Every registered query against its SQL statement on the same tables."""

import math
import os

import duckdb
import pytest
from conftest import TABLES

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if value is not None and type(value).__name__ == "Decimal":
        return round(float(value), 9)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, name):
    result = entry_module.queries()[name](spark, SF_DIR)
    rows = _rows(result.columns, result.collect())
    assert rows
    plan = result._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    expected = duck.execute(sql)
    names = [column[0] for column in expected.description]
    assert sorted(names) == sorted(result.columns)
    assert rows == _rows(names, expected.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
