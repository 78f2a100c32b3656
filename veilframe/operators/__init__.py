"""Operators on DataFrames of texts and of findings."""
