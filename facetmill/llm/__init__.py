"""Operators that prepare, check and balance training data. Nothing outside this package imports it."""
