"""Narrated-text analytics on Spark DataFrames."""
