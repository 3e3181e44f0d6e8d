"""Satellite-catalogue and launch analytics on Spark DataFrames."""
