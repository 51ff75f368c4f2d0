"""Every registered query, grouped by subject."""

from . import area_queries, convert_queries, demand_queries, editing_queries, geometry_queries, graph_queries, nearest_queries, network_queries, object_queries, observe_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
