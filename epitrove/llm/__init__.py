"""Operators for preparing training text, as functions from Spark DataFrames to Spark DataFrames."""
