"""lakeglean: credit-style scoring analytics on Spark DataFrames."""
