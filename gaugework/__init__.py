"""Data and model quality analytics on Spark DataFrames."""
