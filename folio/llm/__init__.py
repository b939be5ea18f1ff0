"""Operators of a training-data pipeline: search, packing, joins, tokens, filters, formats, archives, dedup.

Nothing outside this subpackage and the driver's entry module imports it.
"""
