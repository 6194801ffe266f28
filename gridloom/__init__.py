"""gridloom: sparse-matrix analytics on Spark DataFrames."""
