"""Schema shaping and input checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters replaced by '_' in column names.
NAME_PATTERN = r"[\s\[\]<>]"
# Accepted spellings of a user-supplied space-group column.
SPACE_GROUP_ALIASES = ["space_group", "space_group_number", "spacegroup", "spacegroup_number"]


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim surrounding whitespace of every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def sanitize_column_names(df: DataFrame) -> DataFrame:
    """Whitespace, '[', ']', '<', '>' -> '_'. Two names colliding is an error."""
    new = [re.sub(NAME_PATTERN, "_", c) for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise ValueError(f"column names collide after sanitising: {dup}")
    return df.toDF(*new)


def to_double(c: Column | str) -> Column:
    """Numeric coercion, bad text and NaN -> NULL (``try_cast``; surrounding blanks allowed)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def first_non_null(df: DataFrame, cols: list[str], name: str, drop_inputs: bool = False) -> DataFrame:
    """``name`` = first non-null of ``cols`` (numeric); absent columns count as NULL."""
    present = [to_double(c) for c in cols if c in df.columns]
    out = df.withColumn(name, F.coalesce(*present, F.lit(None).cast("double")) if present
                        else F.lit(None).cast("double"))
    return out.drop(*[c for c in cols if c in df.columns]) if drop_inputs else out


def ensure_columns(df: DataFrame, target: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly ``target`` columns in order; missing ones are ``fill``, extras dropped."""
    present = set(df.columns)
    return df.select([F.col(f"`{c}`") if c in present else F.lit(fill).cast("double").alias(c)
                      for c in target])


def first_present(df: DataFrame, aliases: list[str] = SPACE_GROUP_ALIASES) -> str | None:
    """The first alias that is a column of ``df``."""
    return next((a for a in aliases if a in df.columns), None)


def normalize_space_group(df: DataFrame, target: str = "user_space_group_number") -> DataFrame:
    """Rename the first present space-group alias to ``target`` (numeric).

    Done before the database lookups, so they can use it (the reference
    renames after them, N3).
    """
    src = first_present(df)
    if src is None:
        return df
    return df.withColumn(src, to_double(src)).withColumnRenamed(src, target)


def add_log_target(df: DataFrame, target: str, name: str | None = None) -> DataFrame:
    """log1p of the target beside it."""
    return df.withColumn(name or f"{target}_log", F.log1p(target))


def validate_input(df: DataFrame, required: list[str], space_group: str | None = None,
                   key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fail on missing required columns; count invalid space groups.

    Returns (summary row: n_rows, n_invalid; all offenders, ordered by
    ``key``). Invalid means missing, not numeric or outside 1..230.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if space_group is None or space_group not in df.columns:
        summary = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("bigint").alias("n_invalid"))
        return summary, df.limit(0)
    sg = to_double(space_group)
    bad = sg.isNull() | (sg < 1) | (sg > 230)
    summary = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bad.cast("long")).alias("n_invalid"))
    offenders = df.where(bad)
    if key:
        offenders = offenders.orderBy(key)
    return summary, offenders
