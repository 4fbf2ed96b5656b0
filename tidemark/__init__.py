"""Time-series compression and signal analytics on Spark DataFrames."""
