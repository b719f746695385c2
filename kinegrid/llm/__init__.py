"""Operators for training-data pipelines: quality, duplicates, contamination, formatting and scoring."""
