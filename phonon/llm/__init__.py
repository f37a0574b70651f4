"""Operators for large text corpora (training-data pipelines).

Nothing else in the package imports this subpackage; the driver entry adds
its queries only where it is present.
"""
