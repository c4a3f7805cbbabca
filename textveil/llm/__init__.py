"""Operators of a training-data pipeline: scoring, deduplication, mixing, packing, archives.

Nothing else in the library imports this subpackage.
"""
