"""Every operator as a query over the given tables, with its SQL statement where one exists."""

from tuneprep.queries.registry import QUERIES, SQL
from tuneprep.queries import metrics, reads, splits, streams, texts, tokens, whole  # noqa: F401  (they register)

__all__ = ["QUERIES", "SQL"]
