"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it, and it imports nothing of the rest of
the library.  Every operator takes and returns DataFrames, works over its whole input, and documents
what it does with nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns.
"""
