"""All queries and oracles of the library itself."""

from __future__ import annotations

from tickloom.plans import label_queries, more_queries, piece_queries, signal_queries, ta_queries, training_queries  # noqa: F401
from tickloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
