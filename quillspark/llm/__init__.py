"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps whole texts and whole tables, and documents what it does with
nulls, empty texts, repeated rows, empty tables and extra columns.
"""
