"""All registered session queries: importing this registers them."""

from lagoon.plans import accounts, attributing, estimating, growing, readings, recorded, rules, tracing  # noqa: F401
from lagoon.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
