"""Training-data operators: deduplication, filtering, mixing, tokenising and output.

Every operator is a function over DataFrames; ``queries.py`` holds the thin
registered queries with the fixed result columns.
"""
