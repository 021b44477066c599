"""Operators for large text corpora. Nothing outside this package imports it."""
