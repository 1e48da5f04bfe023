"""Operators on source text and documents for training-data pipelines; nothing else in the library imports them."""
