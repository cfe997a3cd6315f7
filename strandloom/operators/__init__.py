"""Spark operators: DataFrames in, DataFrames out."""
