"""All registered queries."""

from tidemark.plans import masking, refresh, retention, savings, snapshots  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
