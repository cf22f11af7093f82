"""Sensitive-content analytics on Spark DataFrames."""
