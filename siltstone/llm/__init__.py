"""Operators of a training-data pipeline: search, deduplication, filtering, extraction, scoring and tokenisation.

Nothing else in the library imports this subpackage.
"""
