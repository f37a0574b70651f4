"""Merging measurement sources.

The plan is: standardise each source -> union by name -> parse temperature
-> keep one row per (formula, temperature) by source priority -> drop rows
missing the target -> group mean and source list. Dedupe and group use the
same keys, so Spark shuffles once for both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chemistry import classify_property
from ..functions.temperature import parse_temperature

# Source tags, in priority order (first wins a duplicate).
SOURCE_PRIORITY = ["citrine", "ucsb", "nist_thermoml"]
# Canonical names of the long-table properties after pivot.
LONG_PROPERTIES = ["density", "thermalconductivity"]
KEYS = ["formula", "temperature"]


def standardize_citrine(df: DataFrame) -> DataFrame:
    """Source 1: drop rows without k_expt, rename, tag."""
    return (df.dropna(subset=["k_expt"])
            .withColumnsRenamed({"k_expt": "thermal_conductivity", "k_condition": "temperature"})
            .withColumn("source", F.lit("citrine")))


def standardize_ucsb(df: DataFrame) -> DataFrame:
    """Source 2: rename composition/kappa, tag."""
    return (df.withColumnsRenamed({"composition": "formula", "kappa": "thermal_conductivity"})
            .withColumn("source", F.lit("ucsb")))


def keep_crystalline(df: DataFrame, phase_col: str = "phase") -> DataFrame:
    """Phase contains 'crystal' (any case); NULL phase is dropped."""
    if phase_col not in df.columns:
        return df
    return df.where(F.coalesce(F.lower(F.col(phase_col)).contains("crystal"), F.lit(False)))


def standardize_property_names(df: DataFrame, col: str = "property") -> DataFrame:
    """C3 + H2: classify property names, drop the unrecognised ones."""
    if col not in df.columns:
        return df
    return df.withColumn(col, classify_property(col)).where(F.col(col).isNotNull())


def pivot_first(df: DataFrame, keys: list[str], pivot_col: str, value_col: str,
                values: list[str], order: list[Column]) -> DataFrame:
    """One column per pivot value holding the first non-null value.

    "First" is by ``order`` (give a full tie-break), so the result does not
    depend on file or partition order. Rows with a NULL key or value are
    dropped first, as a pandas pivot table does. The value list is fixed,
    and each output column is one conditional ``min_by`` in a single
    aggregate grouped by the keys (one exchange, map-side partial step). A
    value outside the list is an error, so no row disappears unseen.
    """
    clean = df.dropna(subset=keys + [pivot_col, value_col])
    known = F.when(F.col(pivot_col).isin(values), F.col(pivot_col)).otherwise(F.raise_error(
        F.concat(F.lit(f"{pivot_col} has a value without a column: "), F.col(pivot_col))))
    clean = clean.withColumn(pivot_col, known)
    ordering = F.struct(*order, F.col(value_col))
    hit = lambda v: F.col(pivot_col) == F.lit(v)
    return clean.groupBy(*keys).agg(*[
        F.min_by(F.when(hit(v), F.col(value_col)), F.when(hit(v), ordering)).alias(v) for v in values])


def standardize_nist(df: DataFrame, order: list[Column]) -> DataFrame:
    """Source 3 (long form): crystalline only, known properties, pivot, tag."""
    wide = pivot_first(standardize_property_names(keep_crystalline(df)),
                       [c for c in KEYS if c in df.columns], "property", "value",
                       LONG_PROPERTIES, order)
    return (wide.withColumnRenamed("thermalconductivity", "thermal_conductivity")
            .withColumn("source", F.lit("nist_thermoml")))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """G1: union by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def priority_rank(col: str = "source", priorities: list[str] = SOURCE_PRIORITY) -> Column:
    """Position of a source in the priority list; unknown sources go last."""
    expr = F.when(F.lit(False), F.lit(0))
    for i, p in enumerate(priorities):
        expr = expr.when(F.col(col) == p, F.lit(i))
    return expr.otherwise(F.lit(len(priorities)))


def dedupe_by_priority(df: DataFrame, keys: list[str] = KEYS, tie_break: list[Column] = (),
                       source_col: str = "source",
                       priorities: list[str] = SOURCE_PRIORITY) -> DataFrame:
    """keep one row per key, the one from the best source.

    Ties inside a source are broken by ``tie_break`` (the reference leaves
    them to an unstable sort). NULL keys form one group, as in pandas.
    ``row_number() = 1`` plans a partial WindowGroupLimit before the
    exchange, so even a key that holds a third of all rows is cut to one
    row per map task before it is shuffled.
    """
    w = Window.partitionBy(*keys).orderBy(priority_rank(source_col, priorities), *tie_break)
    return (df.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


def group_measurements(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean target and the sorted distinct list of sources per key."""
    return (df.groupBy(*keys)
            .agg(F.avg("thermal_conductivity").alias("thermal_conductivity"),
                 F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source")))


def merge_measurements(sources: list[DataFrame], tie_break: list[Column] = (),
                       drop_missing: bool = True, drop_null_first: bool = False) -> DataFrame:
    """J30 (merge part): union, parse, dedupe, clean, group.

    ``drop_null_first`` drops rows without a target before the dedupe, so a
    NULL measurement of a better source no longer hides a real one of a
    worse source (the reference dedupes first; that is the default).
    """
    typed = [s.withColumn("temperature", parse_temperature(
        "temperature", s.schema["temperature"].dataType)) for s in sources]
    all_rows = union_by_name(*typed)
    if drop_null_first:
        all_rows = all_rows.dropna(subset=KEYS + ["thermal_conductivity"])
    deduped = dedupe_by_priority(all_rows, KEYS, list(tie_break))
    if drop_missing:
        deduped = deduped.dropna(subset=KEYS + ["thermal_conductivity"])
    # The reference groups by the dedupe keys afterwards (mean, sorted source
    # list). After the dedupe each key holds exactly one row, so that group
    # is the identity: the mean of one value is the value and the list is
    # the one source. Projecting instead saves a shuffle; group_measurements
    # stays for tables that were not deduped.
    return deduped.select(*KEYS, F.col("thermal_conductivity").cast("double").alias("thermal_conductivity"),
                          F.col("source").cast("string").alias("source"))


def impute_and_clean(df: DataFrame) -> DataFrame:
    """J2 on the merged table: parse temperature, fill missing with the mean,
    drop rows without formula or target.

    The mean is fitted by one global aggregate (one row reaches the driver,
    like any ML ``fit``) and applied as a literal.
    """
    dtype = df.schema["temperature"].dataType
    parsed = df.withColumn("temperature", parse_temperature("temperature", dtype))
    mean_t = parsed.agg(F.avg("temperature")).first()[0]
    filled = parsed if mean_t is None else parsed.withColumn(
        "temperature", F.coalesce("temperature", F.lit(float(mean_t))))
    return filled.dropna(subset=["formula", "thermal_conductivity"])
