"""The nearest rows found, against SQL over all pairs; sums in another order differ in the last digits."""

import os

import duckdb
import pytest

from tuneprep.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NEAREST = """
WITH vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT q.vec_id AS query_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, r.vec_id AS vec_id, list_cosine_similarity(q.v, r.v) AS score
FROM vectors q JOIN vectors r ON q.vec_id <> r.vec_id
WHERE q.vec_id % 50 = 0
WINDOW nearest AS (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, r.v) DESC, r.vec_id)
QUALIFY row_number() OVER nearest <= 5
"""


def test_nearest_rows(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    expected = sorted(connection.execute(NEAREST).fetchall())
    found = sorted(tuple(r) for r in QUERIES["op2_learned_partitions"](spark, SF_DIR).select("query_id", "rank", "vec_id", "score").collect())
    assert [row[:3] for row in found] == [row[:3] for row in expected]
    assert [row[3] for row in found] == pytest.approx([row[3] for row in expected], abs=1e-12)
