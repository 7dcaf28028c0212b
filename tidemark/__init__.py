"""A point-in-time analytics engine built from Spark DataFrames."""
