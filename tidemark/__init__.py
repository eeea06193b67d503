"""Station time-series analytics on Spark DataFrames."""
