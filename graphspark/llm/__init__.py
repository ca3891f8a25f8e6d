"""Operators of a training-data pipeline over text, token and media tables.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries are in ``graphspark.llm.queries``.
"""
