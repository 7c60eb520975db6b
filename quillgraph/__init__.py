"""Cited-relationship analytics on Spark DataFrames."""
