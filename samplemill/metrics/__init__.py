"""Metrics: each factory returns a function (rows, by) -> one row per group with the values as columns.

`by` is a list of columns; without any, the result has one row. Undefined values are null.
"""
