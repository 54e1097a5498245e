"""DataFrame operators: bucketing, posting lists and the time-series operators."""
