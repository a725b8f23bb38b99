"""Lattica: analytics over tabular files and training text, on Spark DataFrames."""
