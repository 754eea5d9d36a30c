"""All registered queries of the library."""

from pricetide.plans import entities, gate, jobs, market, more, ops, review, streams, text  # noqa: F401
from pricetide.plans.registry import oracle, queries

__all__ = ["oracle", "queries"]
