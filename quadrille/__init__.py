"""A graph-query engine on Spark DataFrames."""
