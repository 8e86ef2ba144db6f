"""Operators of a training-data pipeline: quality, language, personal data, near copies, leakage, mixing and sharding."""
