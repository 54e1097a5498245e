"""Tagged time-series analytics on Spark DataFrames."""
