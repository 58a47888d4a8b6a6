"""Operators on corpora for model training. Nothing outside this package imports it."""
