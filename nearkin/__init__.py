"""Thresholded string-similarity joins and sequence statistics on Spark DataFrames."""

__version__ = "1.1"
