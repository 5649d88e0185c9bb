"""Vector search on Spark: exact and graph-based nearest neighbours as DataFrames."""
