"""The registered queries and their SQL."""

from __future__ import annotations

from .plans import answer_queries, fold_queries, message_queries, retrieval_queries, stats_queries, stream_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
