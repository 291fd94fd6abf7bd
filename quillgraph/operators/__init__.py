"""Operators as functions over DataFrames."""
