"""Operators from DataFrames to DataFrames. None collects rows that grow with the data."""
