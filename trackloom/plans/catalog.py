"""All registered queries."""

from __future__ import annotations

from trackloom.plans import file_queries, report_queries, retrieval_queries, tracklet_queries, vector_queries
from trackloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "file_queries", "report_queries", "retrieval_queries", "tracklet_queries", "vector_queries"]
