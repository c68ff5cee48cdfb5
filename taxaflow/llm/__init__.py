"""Operators for training-data pipelines: scoring, filters, deduplication, tokens."""
