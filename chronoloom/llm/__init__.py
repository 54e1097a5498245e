"""Operators that prepare training data: percentiles, runs, and the text operators."""
