"""Windowed aggregation with reusable partial results, on Spark DataFrames."""
