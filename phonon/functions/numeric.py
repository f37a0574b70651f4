"""H5, H7, H8: numeric column functions with the missing-value rule.

numpy gives NaN for log1p(-2) and -inf for log1p(-1); Spark gives NULL for
both, and NULL is the only missing value in this library (NaN is turned
into NULL at the sources), so the Spark behaviour is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log1p(c: Column | str) -> Column:
    """H5: log(1 + x); NULL for x <= -1."""
    return F.log1p(_c(c))


def expm1(c: Column | str) -> Column:
    """H5: exp(x) - 1, the inverse of ``log1p``."""
    return F.expm1(_c(c))


def log10_positive(c: Column | str) -> Column:
    """H5 + C4: log10 of positive values, NULL otherwise."""
    x = _c(c)
    return F.when(x > 0, F.log10(x))


def residual(actual: Column | str, predicted: Column | str) -> Column:
    """H8: actual - predicted."""
    return _c(actual) - _c(predicted)


def round_half_even(c: Column | str, digits: int = 3) -> Column:
    """H7: numpy-style rounding (half to even), not Spark's half-up ``round``."""
    return F.bround(_c(c), digits)
