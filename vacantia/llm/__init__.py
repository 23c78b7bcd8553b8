"""Operators for large training-data pipelines, their queries and SQL oracles."""
