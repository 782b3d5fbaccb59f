"""Operators of a training-data pipeline: tokens, dedup, filters, scoring, mixing."""
