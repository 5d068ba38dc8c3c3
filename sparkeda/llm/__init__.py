"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this package; ``queries`` registers one query
per operator. Every operator takes DataFrames and column names, selects the columns
it needs first (extra columns with clashing names never reach it) and returns a
DataFrame.
"""
