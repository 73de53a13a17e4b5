"""All queries of the library: importing the modules registers them."""

from cairn.plans import analysis_queries, flatten_queries, history_queries, metric_queries, query_queries, stream_queries  # noqa: F401
from cairn.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
