"""Column-association analytics on Spark DataFrames."""
