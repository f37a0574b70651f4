"""Join helpers.

No join here carries a broadcast hint that depends on a guess: adaptive
execution sees the real bytes of each side at run time and broadcasts a
small one, or splits a skewed one. Only tables whose number of rows is fixed
by construction (one per column, cluster or bracket) are hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_bounded(df: DataFrame) -> DataFrame:
    """Broadcast a table whose row count is bounded by construction (one row
    per column, per cluster, per bracket), never by the data size."""
    return F.broadcast(df)


def lookup_join(df: DataFrame, table: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Attach attributes of a lookup table (left join by default)."""
    return df.join(table, on=on, how=how)


def attach_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner join of a label table on a real key (the reference joins on row index)."""
    return df.join(labels, on=key, how="inner")


def add_columns(df: DataFrame, exprs: dict) -> DataFrame:
    """Column-wise concat is a projection when the columns derive from the row."""
    return df.withColumns(exprs)
