"""Operators for preparing language-model training data.

Each module holds one operator with its own interface (DataFrames in,
DataFrames out); ``queries`` applies them to the given tables.
"""
