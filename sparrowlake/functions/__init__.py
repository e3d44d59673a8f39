"""Scalar and aggregate function names of other SQL dialects."""
