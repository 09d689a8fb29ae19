"""Graph-link ranking analytics on Spark DataFrames."""
