"""Expression analytics on Spark DataFrames."""
