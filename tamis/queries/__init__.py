"""All checked queries."""

from tamis.queries import basics, comparisons, flows, ordering, reports, streams  # noqa: F401
from tamis.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
