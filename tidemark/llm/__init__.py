"""Operators for large text corpora: ten operators, each on Spark DataFrames."""
