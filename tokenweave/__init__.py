"""Multi-vector retrieval and corpus processing on Spark DataFrames."""
