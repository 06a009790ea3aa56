"""Operators of a large-scale training-data pipeline; nothing outside this package imports it."""
