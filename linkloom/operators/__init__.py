"""Linkage operators on DataFrames."""
