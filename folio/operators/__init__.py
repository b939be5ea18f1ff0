"""Relational operators: catalog, quality, cost model, state."""
