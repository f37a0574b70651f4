"""Composition features (I0-I3): element statistics, p-norms, valence orbitals.

Input: a long composition table (row id, element, amount) and an element
property table (element, one column per property). Plan: impute missing
element properties with the table mean -> join the (checked-small) property
table -> a window by row id puts each composition's totals beside its
element rows (a composition is bounded by the number of distinct elements,
at most 118) -> one aggregate by row id, all plain codegen'd sums, minima
and maxima (avg_dev and mode read the totals). Sums are
written over whole amounts with one division at the end
(mean = S/Q, avg_dev = sum(q |p Q - S|) / Q^2), which keeps them exact for
whole-number inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Statistics of the element-property features, and p-norm orders.
STATS = ["minimum", "maximum", "range", "mean", "avg_dev", "mode"]
NORM_ORDERS = [0, 2, 3, 5, 7, 10]
ORBITALS = ["s", "p", "d", "f"]


def impute_with_means(table: DataFrame, cols: list[str]) -> DataFrame:
    """Missing element properties -> mean of the property over the table.

    One global aggregate fits the means (one row to the driver); they are
    applied as literals.
    """
    means = table.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return table.withColumns({
        c: F.coalesce(F.col(c), F.lit(means[c]).cast("double")) if means[c] is not None
        else F.col(c).cast("double") for c in cols})


def _joined(comp: DataFrame, props: DataFrame, prop_cols: list[str], element_col: str,
            amount_col: str, impute: bool) -> DataFrame:
    table = impute_with_means(props, prop_cols) if impute else props
    table = table.select(F.col(element_col), *[F.col(c).cast("double").alias(c) for c in prop_cols])
    joined = comp.join(table, on=element_col, how="left")
    return joined.where(F.col(amount_col) > 0).withColumn("_q", F.col(amount_col).cast("double"))


def composition_features(comp: DataFrame, props: DataFrame, stat_props: list[str],
                         orbital_cols: dict[str, str] | None = None, id_col: str = "row_id",
                         element_col: str = "element", amount_col: str = "amount",
                         impute: bool = True, naming: str = "plain") -> DataFrame:
    """I1 + I2 + I3 in one grouped pass, one row per composition id.

    Sums, minima, maxima and power sums are ordinary aggregates (codegen'd,
    partially aggregated map-side). The two statistics that need the row's
    mean or its largest amount first (avg_dev, mode) read them from a window
    over the same partitioning. ``naming='magpie'`` gives the reference's
    column names after B4 ('MagpieData_mean_<prop>', '2-norm',
    'avg_s_valence_electrons').
    """
    orbital_cols = orbital_cols or {}
    prop_cols = list(dict.fromkeys(list(stat_props) + list(orbital_cols.values())))
    if naming == "magpie":
        stat_name = lambda s, p: f"MagpieData_{s}_{p}"
        norm_name = lambda p: f"{p}-norm"
    else:
        stat_name = lambda s, p: f"{s}_{p}"
        norm_name = lambda p: f"norm_{p}"
    j = _joined(comp, props, prop_cols, element_col, amount_col, impute)
    q = F.col("_q")
    # per-composition totals beside every element row (a window over one
    # composition, at most 118 rows); the aggregate below reuses its
    # partitioning, so the whole operator shuffles once
    w = Window.partitionBy(id_col)
    j = j.withColumns({"_Qw": F.sum(q).over(w), "_MQw": F.max(q).over(w),
                       **{f"_Sw_{p}": F.sum(q * F.col(p)).over(w) for p in stat_props}})
    aggs = [F.max("_Qw").alias("_Q"), F.count(F.lit(1)).alias("_N")]
    for p in stat_props:
        aggs += [F.min(p).alias(f"_min_{p}"), F.max(p).alias(f"_max_{p}"),
                 F.max(f"_Sw_{p}").alias(f"_S_{p}"),
                 F.sum(q * F.abs(F.col(p) * F.col("_Qw") - F.col(f"_Sw_{p}"))).alias(f"_D_{p}"),
                 F.min(F.when(q == F.col("_MQw"), F.col(p))).alias(f"_M_{p}")]
    for k in NORM_ORDERS:
        if k:
            aggs.append(F.sum(F.pow(q, F.lit(float(k)))).alias(f"_P{k}"))
    for o, c in orbital_cols.items():
        aggs.append(F.sum(q * F.col(c)).alias(f"_V_{o}"))
    g = j.groupBy(id_col).agg(*aggs)

    Q = F.col("_Q")
    cols = []
    for p in stat_props:
        mn, mx, s = F.col(f"_min_{p}"), F.col(f"_max_{p}"), F.col(f"_S_{p}")
        cols += [mn.alias(stat_name("minimum", p)), mx.alias(stat_name("maximum", p)),
                 (mx - mn).alias(stat_name("range", p)), (s / Q).alias(stat_name("mean", p)),
                 (F.col(f"_D_{p}") / (Q * Q)).alias(stat_name("avg_dev", p)),
                 F.col(f"_M_{p}").alias(stat_name("mode", p))]
    for k in NORM_ORDERS:
        cols.append(F.col("_N").cast("double").alias(norm_name(k)) if k == 0 else
                    (F.pow(F.col(f"_P{k}"), F.lit(1.0 / k)) / Q).alias(norm_name(k)))
    if orbital_cols:
        total = None
        for o in orbital_cols:
            total = F.col(f"_V_{o}") if total is None else total + F.col(f"_V_{o}")
        cols += [(F.col(f"_V_{o}") / Q).alias(f"avg_{o}_valence_electrons") for o in orbital_cols]
        cols += [F.when(total != 0, F.col(f"_V_{o}") / total).alias(f"frac_{o}_valence_electrons")
                 for o in orbital_cols]
    return g.select(id_col, *cols)
