"""Operators over chunk tables, each a function from DataFrames to a DataFrame."""
