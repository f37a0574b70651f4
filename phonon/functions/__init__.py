"""Scalar column expressions (no Python UDFs)."""
