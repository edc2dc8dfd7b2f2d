"""Code-governance analytics on Spark DataFrames."""
