"""Operators: DataFrames and parameters in, DataFrame out. Nothing is collected; the current time is a parameter."""
