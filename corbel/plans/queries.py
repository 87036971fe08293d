"""All queries of the core: importing this module registers them."""

from corbel.plans import source_queries, structure_queries, text_queries  # noqa: F401
from corbel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
