"""Operators for training-data pipelines: fingerprints, tokens, deduplication, mixing, scoring, chat formats."""
