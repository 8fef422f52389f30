"""Network-epistasis analytics on Spark DataFrames."""
