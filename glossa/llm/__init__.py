"""Operators for training-data pipelines: deduplication, quality, mixing, tokenising, sharding.

Nothing outside this subpackage imports it. Queries and their SQL are in ``queries.py``.
"""
