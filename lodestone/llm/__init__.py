"""Operators of a training-data pipeline: cleaning, deduplication, scoring, mixing and packing of documents.

Nothing outside this folder imports it. ``catalog`` lists its queries.
"""
