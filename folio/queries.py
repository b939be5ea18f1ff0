"""All queries of the engine, and their SQL."""

from folio.plans import analytics_queries, catalog_queries, inventory_queries, search_queries, state_queries, text_queries  # noqa: F401  (they register themselves)
from folio.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
