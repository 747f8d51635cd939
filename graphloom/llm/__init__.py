"""Operators for training-data pipelines: deduplication, joins, mixing, extraction, tokenising.

Nothing else in the package imports this subpackage.
"""
