"""Operators of a training-data pipeline: deduplication, search, scoring, token and mixing jobs."""
