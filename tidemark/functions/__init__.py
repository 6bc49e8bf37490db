"""Scalar helpers and their registration for SQL."""
