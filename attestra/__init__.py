"""Document-evidence operators on Spark DataFrames."""
