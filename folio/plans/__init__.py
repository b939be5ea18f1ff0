"""Queries, and search plans."""
