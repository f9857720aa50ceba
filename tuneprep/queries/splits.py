"""Ordered limits and exact splits."""

from __future__ import annotations

from tuneprep.operators.ordering import first_n, with_running_total
from tuneprep.operators.splits import exact_split, split_sizes
from tuneprep.queries import sql
from tuneprep.queries.registry import query
from tuneprep.sources import views

ROWS, TEST_ROWS, SEED = 5000, 400, 7
SPLIT_CTE = sql.split("marked", "orders", ["o_orderkey"], TEST_ROWS, SEED)


@query(
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT {ROWS}", "first_n"
)
def first_orders(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return first_n(orders, ROWS, ["o_totalprice", "o_orderkey"])


@query(f"WITH {SPLIT_CTE} SELECT o_orderkey, split, split_hash FROM marked", "exact_split")
def split_orders(spark, sf_dir):
    marked = exact_split(views.table(spark, sf_dir, "orders"), TEST_ROWS, SEED, ["o_orderkey"])
    return marked.select("o_orderkey", "split", "split_hash")


@query(
    f"WITH {SPLIT_CTE} SELECT o_orderkey, split, "
    "row_number() OVER (PARTITION BY split ORDER BY split_hash, o_orderkey) - 1 AS position FROM marked"
)
def split_order(spark, sf_dir):
    """The shuffled order in which both parts go on."""
    marked = exact_split(views.table(spark, sf_dir, "orders"), TEST_ROWS, SEED, ["o_orderkey"])
    order = ["split_hash", "o_orderkey"]
    placed = with_running_total(marked.select("split", *order), order, group_by=["split"], before="position")
    return placed.select("o_orderkey", "split", "position")


@query(f"WITH {SPLIT_CTE} SELECT split, count(*) AS rows FROM marked GROUP BY split", "split_sizes")
def sizes_of_split(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return split_sizes(exact_split(orders, TEST_ROWS, SEED, ["o_orderkey"]))
