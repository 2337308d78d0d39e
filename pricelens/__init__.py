"""Retail price intelligence on Spark DataFrames."""
