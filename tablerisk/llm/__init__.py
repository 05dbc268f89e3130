"""Operators of a training-data pipeline over tables of documents and web pages.

Nothing else in the library imports this subpackage. Each operator is a function from
DataFrames to DataFrames; the registered queries and their SQL are in ``queries.py``.
"""
