"""Scalar and text functions as column expressions."""
