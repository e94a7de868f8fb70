"""All queries of the engine, by name, with their oracle SQL."""

from __future__ import annotations

from .plans import check_queries, history_queries, pipeline_queries, search_queries, text_queries
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "check_queries", "history_queries", "pipeline_queries", "search_queries", "text_queries"]
