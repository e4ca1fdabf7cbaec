"""Named queries over the bound tables."""

from . import content, coverage, decisions, evidence, mechanisms, merges, pairing, queues, records, signals  # noqa: F401  each registers its queries
from ._registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
