"""Operators of a training-data pipeline: dedup, extraction, filtering, tokenising and sharding of text at scale."""
