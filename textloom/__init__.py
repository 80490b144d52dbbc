"""textloom: semantic text analytics on Spark DataFrames."""
