"""Operators: each takes DataFrames and named parameters and returns a DataFrame."""
