"""Measurement-series analytics on Spark DataFrames."""
