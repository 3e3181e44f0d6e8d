"""Warehouse builds and reports, each a function from DataFrames to a DataFrame."""
