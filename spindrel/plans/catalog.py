"""All queries of the core; importing the modules registers them."""

from spindrel.plans import construct_queries, geometry_queries, graph_queries, message_queries, metric_queries, model_queries, protein_queries, ragged_queries, sampling_queries  # noqa: F401
from spindrel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
