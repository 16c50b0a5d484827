"""Operators of a training-data pipeline: filtering, deduplication, redaction, mixing, media and tokens."""
