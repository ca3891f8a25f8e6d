"""Algebra, query text, gate and compiler: from a query to a DataFrame."""
