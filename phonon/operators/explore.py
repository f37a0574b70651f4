"""Exploration tables.

These are the tables behind the reference's charts and printed summaries.
Each is one or two aggregates (partial + final) over the whole table; the
few results that are single numbers reach the driver as one row.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import log10_positive
from ..session import scratch_path, ship_package
from .joins import broadcast_bounded
from .quantiles import exact_quantiles


# ---------------------------------------------------------------- shapes

def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Numeric columns minus ``exclude`` (booleans are not numeric)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def to_long(df: DataFrame, cols: list[str], ids: list[str] = (), name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide -> long (unpivot) with every value cast to double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(ids), cols, name, value)


# ---------------------------------------------------------------- group summaries

def cluster_summary(df: DataFrame, label: str, mean_cols: dict[str, str],
                    count_col: str, count_name: str = "count") -> DataFrame:
    """Per label, means of some columns and the count of non-null ``count_col``."""
    return df.groupBy(label).agg(*[F.avg(c).alias(n) for n, c in mean_cols.items()],
                                 F.count(count_col).alias(count_name))


def mode_by_group(df: DataFrame, group: list[str], col: str, name: str,
                  empty: str = "Unknown") -> DataFrame:
    """Most frequent non-null value per group, smallest on a tie; ``empty`` if none.

    Two aggregates (count per value, then the best value per group), both
    with map-side partial steps, so a hot group never holds its values in
    one buffer.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*group).agg(
        F.min_by(F.col(col), F.struct((-F.col("_c")).alias("_nc"), F.col(col).alias("_v"))).alias(name))
    keys = df.select(*group).distinct()
    return keys.join(best, on=group, how="left").withColumn(name, F.coalesce(F.col(name), F.lit(empty)))


def cluster_profile(df: DataFrame, label: str, stat_cols: dict[str, str],
                    mode_col: str | None = None, mode_name: str = "dominant") -> DataFrame:
    """Mean and sample std per label of ``stat_cols`` (output prefix -> column),
    optional ones skipped when absent, plus the mode of a category column."""
    aggs = []
    for prefix, c in stat_cols.items():
        if c in df.columns:
            aggs += [F.avg(c).alias(f"mean_{prefix}"), F.stddev_samp(c).alias(f"std_{prefix}")]
    out = df.groupBy(label).agg(*aggs)
    if mode_col and mode_col in df.columns:
        out = out.join(mode_by_group(df, [label], mode_col, mode_name), on=label, how="left")
    return out


# The cluster-analysis summary's output prefixes and source columns.
CLUSTER_ANALYSIS_STATS = {
    "kappa": "thermal_conductivity", "T": "temperature", "density": "mp_density",
    "molar_mass": "MagpieData_mean_MolarMass", "band_gap": "mp_band_gap",
}


def prepare_cluster_analysis(df: DataFrame, labels: DataFrame, key: str,
                             label: str = "cluster_label") -> DataFrame:
    """E4 with the reference's output names: join labels on a real key, then
    mean/std of kappa and T (and of density, molar mass, band gap when
    present) and the dominant crystal system ('Unknown' when none)."""
    joined = df.join(labels.select(key, label), on=key, how="inner")
    return cluster_profile(joined, label, CLUSTER_ANALYSIS_STATS,
                           mode_col="crystal_system_classified", mode_name="dominant_crystal_system")


# ---------------------------------------------------------------- counts and shares (E5, F2)

def contingency_share(df: DataFrame, x: str, cat: str) -> DataFrame:
    """E5 + F2: count per (x, category), nulls dropped, and percent of the x total."""
    counts = df.dropna(subset=[x, cat]).groupBy(x, cat).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(x))
    return counts.withColumn("percent", F.col("count") / total * 100)


# ---------------------------------------------------------------- summary statistics

def adjusted_skew(g1: Column, n: Column) -> Column:
    """Sample skewness G1 from the population g1 (pandas / DuckDB convention)."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population excess g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def summary_statistics(df: DataFrame, cols: list[str], log10: bool = False,
                       scales: tuple[str, ...] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max, skew, kurtosis per column.

    ``log10=True`` summarises log10 of the positive values (C4) instead;
    ``scales=("raw", "log10")`` does both in one pass over one long table
    keyed by (scale, feature), with a ``scale`` column in the output.
    Quartiles are exact (``exact_quantiles``).
    """
    wanted = scales or (("log10",) if log10 else ("raw",))
    each = [F.struct(F.lit(sc).alias("scale"),
                     (log10_positive("value") if sc == "log10" else F.col("value")).alias("value"))
            for sc in wanted]
    long = to_long(df, cols).select("feature", F.explode(F.array(*each)).alias("s")).select(
        "s.scale", "feature", "s.value").where(F.col("value").isNotNull())
    keys = ["scale", "feature"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"))
    moments = moments.withColumns({
        "skew": adjusted_skew(F.col("_g1"), F.col("count").cast("double")),
        "kurtosis": adjusted_kurtosis(F.col("_g2"), F.col("count").cast("double"))}).drop("_g1", "_g2")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys, names=["q25", "q50", "q75"])
    out = moments.join(q, on=keys, how="left")
    return out if scales else out.drop("scale")


# ---------------------------------------------------------------- per-column quality

def missing_and_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fraction missing and sample std per column, in one pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__missing"),
                 F.stddev_samp(c).alias(f"{c}__std")]
    row = df.agg(*aggs)
    stack = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__missing").alias("missing_fraction"),
                      F.col(f"{c}__std").alias("std")) for c in cols]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def null_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column, the number of NULLs and whether the column is all NULL."""
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stack = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("null_count"),
                      (F.col(f"`{c}`") == F.col("_n")).alias("all_null")) for c in cols]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def drop_all_null_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop columns with no value (one aggregate row decides)."""
    info = null_columns(df, cols).where("all_null").select("feature").collect()
    return df.drop(*[r.feature for r in info])


# ---------------------------------------------------------------- correlation

def column_stats(df: DataFrame, cols: list[str]) -> dict:
    """One aggregate: per column, non-null count, missing fraction, mean, sample
    std and population variance (plus the row count under key '_n')."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    n = row["_n"]
    out = {"_n": n}
    for i, c in enumerate(cols):
        out[c] = {"count": row[f"n{i}"], "missing": (1 - row[f"n{i}"] / n) if n else None,
                  "mean": row[f"m{i}"], "std": row[f"s{i}"], "var": row[f"v{i}"]}
    return out


def _pair_sums(df: DataFrame, cols: list[str], centre: dict[str, float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every pair of columns i < j, over the rows
    where both are present and after subtracting ``centre``.

    A task keeps five d x d matrices whatever its rows; d (d - 1) / 2 rows
    leave it, and one grouped sum adds the tasks up.
    """
    ship_package(df.sparkSession)
    d, means = len(cols), [centre[c] for c in cols]

    def run(batches):
        import numpy as np
        import pandas as pd
        n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            ok = ~np.isnan(x)
            x = np.where(ok, x - np.asarray(means), 0.0)
            ok = ok.astype(float)
            n += ok.T @ ok
            sx += x.T @ ok                   # sum of column i where j is present
            sxx += (x * x).T @ ok
            sxy += x.T @ x
        i, j = np.triu_indices(d, 1)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i],
                            "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]})

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)]
                      ).mapInPandas(run, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlation_pairs(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    """Pearson correlation of every pair (i < j), pairwise complete, as a long table.

    Columns are centred on their means first, so the sums lose no digits. A
    pair with a constant side on its common rows gives NULL.
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    st = stats or column_stats(df, cols)
    sums = _pair_sums(df, cols, {c: st[c]["mean"] or 0.0 for c in cols})
    names = F.array(*[F.lit(c) for c in cols])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # what rounding leaves of a constant column's spread counts as none
    spread = (F.col("n") > 1) & (vx > 1e-13 * F.col("sxx")) & (vy > 1e-13 * F.col("syy"))
    corr = F.when(spread, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))
    dead = [c for c in cols if not (st[c]["var"] or 0.0) > 0]
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    alive = ~(a.isin(dead) | b.isin(dead)) if dead else F.lit(True)
    return sums.select(a.alias("feature_a"), b.alias("feature_b"),
                       F.when(alive & spread, corr).alias("corr"))


def correlation_with_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Correlation of each column with the target (pairwise complete)."""
    st = column_stats(df, [*cols, target])
    exprs = []
    for c in cols:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        ok = (st[c]["var"] or 0.0) > 0 and (st[target]["var"] or 0.0) > 0
        # covariance over spreads: NULL, not an error, if a side is constant on the common rows
        exprs.append(F.try_divide(
            F.covar_pop(c, target),
            F.stddev_pop(F.when(both, F.col(c))) * F.stddev_pop(F.when(both, F.col(target))))
            if ok else F.lit(None).cast("double"))
    row = df.agg(*[e.alias(f"{i}") for i, e in enumerate(exprs)])
    stack = [F.struct(F.lit(c).alias("feature"), F.col(f"`{i}`").alias("corr"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def top_k_abs(df: DataFrame, value: str, k: int, name: str = "feature") -> DataFrame:
    """top k by absolute value, name breaking ties (a TakeOrderedAndProject)."""
    return df.orderBy(F.abs(F.col(value)).desc_nulls_last(), F.col(name)).limit(k)


# ---------------------------------------------------------------- histograms

def histogram(df: DataFrame, cols: list[str], bins: int = 30, log10: bool = False) -> DataFrame:
    """Equal-width bin counts over min..max per column; the last bin is closed.

    ``log10=True`` bins log10 of the positive values. Output: feature, bin,
    bin_start, bin_end, count (empty bins omitted).
    """
    long = to_long(df, cols).where(F.col("value").isNotNull())
    if log10:
        long = long.where(F.col("value") > 0).withColumn("value", F.log10("value"))
    rng = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = (long.join(broadcast_bounded(rng), on="feature")  # one row per column
              .groupBy("feature", "_lo", "_hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    return counts.select("feature", "bin",
                         (F.col("_lo") + width * F.col("bin") / bins).alias("bin_start"),
                         (F.col("_lo") + width * (F.col("bin") + 1) / bins).alias("bin_end"),
                         "count")


# ---------------------------------------------------------------- box statistics

def box_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """Min, quartiles, max per group (exact quartiles)."""
    mm = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("count"), F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"))
    q = exact_quantiles(df, value,
                        [0.25, 0.5, 0.75], [group], names=["q1", "median", "q3"])
    return mm.join(q, on=group, how="left")


# ---------------------------------------------------------------- regression metrics

def metric_aggs(y: str, yhat: str) -> list[Column]:
    """MAE, RMSE, R2 (= 1 - SSE / SST, SST = n * var_pop(y)) and n as aggregate expressions."""
    err = F.col(y) - F.col(yhat)
    return [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
            F.count(F.lit(1)).alias("n")]


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE, RMSE, R2 in one aggregate over rows with both values."""
    pairs = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return pairs.agg(*metric_aggs(y, yhat))


def evaluate_log_and_original(df: DataFrame, y_log: str, yhat_log: str, y: str) -> DataFrame:
    """E11 on both scales: predictions live on log1p; expm1 brings them back."""
    # one scan: every row gives its pair on either scale to one grouped aggregate
    both = F.array(F.struct(F.lit("log").alias("scale"), F.col(y_log).cast("double").alias("y"),
                            F.col(yhat_log).cast("double").alias("yhat")),
                   F.struct(F.lit("original").alias("scale"), F.col(y).cast("double").alias("y"),
                            F.expm1(yhat_log).alias("yhat")))
    pairs = df.select(F.explode(both).alias("p")).select("p.*")
    return metrics_by(pairs, ["scale"], "y", "yhat").select("mae", "rmse", "r2", "n", "scale")


def metrics_by(df: DataFrame, group: list[str], y: str, yhat: str) -> DataFrame:
    """E11 per group, in one aggregate over rows with both values."""
    pairs = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return pairs.groupBy(*group).agg(*metric_aggs(y, yhat))


# ---------------------------------------------------------------- ANOVA

def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F statistic of ``value`` across groups, with its degrees of freedom.

    Group sums first (partial + final aggregate), then one global row:
    SSB = sum n_g (mean_g - mean)^2, SSW = sum (n_g - 1) var_g.
    """
    g = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
         .groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                             F.var_samp(value).alias("v")))
    tot = g.agg(F.sum("n").alias("n_total"),
                (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m_total"),
                F.count(F.lit(1)).alias("k")).first()
    n_total, m_total, k = tot["n_total"] or 0, tot["m_total"], tot["k"]
    if m_total is None:
        return g.sparkSession.createDataFrame([], "f_stat double, df_between bigint, df_within bigint")
    # the one global row is folded in as literals: no join at all
    out = g.agg(F.sum(F.col("n") * (F.col("m") - F.lit(m_total)) ** 2).alias("ssb"),
                F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"))
    return out.select(
        F.try_divide(F.try_divide(F.col("ssb"), F.lit(k - 1)),
                     F.try_divide(F.col("ssw"), F.lit(n_total - k))).alias("f_stat"),
        F.lit(k - 1).cast("bigint").alias("df_between"), F.lit(n_total - k).cast("bigint").alias("df_within"))


def f_test_pvalue(f_stat: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution: an incomplete beta ratio. One scalar, on the driver."""
    if f_stat is None or d1 <= 0 or d2 <= 0 or not math.isfinite(f_stat):
        return float("nan")
    return beta_ratio(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f_stat))


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b).

    The published fraction x^a (1 - x)^b / (a B(a, b)) / (1 + t1 / (1 + t2 / ...))
    converges fast left of the mean a / (a + b); to the right of it the
    symmetry I_x(a, b) = 1 - I_{1-x}(b, a) is used. The fraction is evaluated
    from its tail, with twice the terms until the value stands still.
    """
    if not 0 < x < 1:
        return float(x >= 1)
    if x > a / (a + b):
        return 1.0 - beta_ratio(b, a, 1.0 - x)

    def term(j: int) -> float:
        m = j // 2
        top = m * (b - m) if j % 2 == 0 else -(a + m) * (a + b + m)
        return top * x / ((a + j - 1) * (a + j))

    value, depth = 0.0, 32
    while depth <= 1 << 16:
        tail = 0.0
        for j in range(depth, 0, -1):
            tail = term(j) / (1.0 + tail)
        value, before = 1.0 / (1.0 + tail), value
        if abs(value - before) <= 1e-15 * abs(value):
            break
        depth *= 2
    scale = (a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a)
             - math.lgamma(b) - math.log(a))
    return math.exp(scale) * value


def feature_significance(df: DataFrame, features: list[str], target: str,
                         label: str | None = None) -> DataFrame:
    """E12 as the reference reports it: with labels, every feature gets the
    ANOVA p-value of the target over the labels; without, its correlation."""
    if label is None:
        return correlation_with_target(df, features, target).withColumnRenamed("corr", "score")
    row = one_way_anova(df, target, label).first()
    p = f_test_pvalue(row.f_stat, row.df_between, row.df_within)
    return df.sparkSession.createDataFrame([(f, float(p)) for f in features], "feature string, score double")


# ---------------------------------------------------------------- normality

def jarque_bera(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """E13 main form: whole-table Jarque-Bera per column.

    JB = n/6 (g1^2 + g2^2/4) with population skewness and excess kurtosis;
    p = exp(-JB/2) (chi-square, 2 dof); normal when p >= alpha.
    """
    long = to_long(df, cols).where(F.col("value").isNotNull())
    m = long.groupBy("feature").agg(F.count("value").alias("n"), F.skewness("value").alias("g1"),
                                    F.kurtosis("value").alias("g2"))
    jb = F.col("n") / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)
    return (m.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))
            .withColumn("is_normal", F.col("p_value") >= alpha).drop("g1", "g2"))


# ---------------------------------------------------------------- scale decision

def decide_scale(df: DataFrame, pred: str, out: str, threshold: float = 25.0,
                 raw_target: bool | None = None) -> DataFrame:
    """Predictions on log1p scale are brought back with expm1, unless the
    batch maximum exceeds ``threshold`` (then they are taken as raw). An
    explicit ``raw_target`` overrides the guess (N8)."""
    if raw_target is None:
        mx = df.agg(F.max(pred)).first()[0]
        raw_target = mx is not None and mx > threshold
    return df.withColumn(out, F.col(pred) if raw_target else F.expm1(pred))


# ---------------------------------------------------------------- series windows

def _order_as_double(df: DataFrame, order: str) -> Column:
    t = df.schema[order].dataType
    if isinstance(t, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def running_share(df: DataFrame, series: str, order: str, value: str,
                  range_rows: int = 100_000) -> DataFrame:
    """cumulative sum / series total along ``order``, per series.

    One row per (series, order value), rows with equal order values
    summed (ties share one cumulative value). A series is never held by a
    single task: the points are cut into ranges of the order value, as many
    as give about ``range_rows`` points each (boundaries from
    ``approxQuantile``); running sums are taken inside each (series, range)
    and shifted by the totals of the earlier ranges, one row per series and
    range. The points are stored once and read by each of these steps.
    """
    from pyspark.ml.feature import Bucketizer
    spark = df.sparkSession
    pts = df.groupBy(series, order).agg(F.sum(value).alias(value))
    pts = pts.withColumn("_o", _order_as_double(pts, order))
    path = scratch_path(spark, f"series/{uuid.uuid4().hex}")
    pts.write.parquet(path)
    pts = spark.read.schema(pts.schema).parquet(path)
    ranges = max(1, math.ceil(pts.count() / range_rows))
    probs = [i / ranges for i in range(1, ranges)]
    bounds = sorted({b for b in pts.approxQuantile("_o", probs, min(0.001, 0.1 / ranges)) if b == b}
                    ) if probs else []
    splits = [-float("inf")] + bounds + [float("inf")]
    if bounds:
        pts = Bucketizer(splits=splits, inputCol="_o", outputCol="_b", handleInvalid="keep").transform(pts)
    else:
        pts = pts.withColumn("_b", F.lit(0.0))
    local = F.sum(value).over(Window.partitionBy(series, "_b").orderBy("_o")
                              .rowsBetween(Window.unboundedPreceding, 0))
    tot = pts.groupBy(series, "_b").agg(F.sum(value).alias("_bt"))
    ws = Window.partitionBy(series).orderBy("_b")
    tot = tot.select(series, "_b",
                     F.coalesce(F.sum("_bt").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0.0)).alias("_off"),
                     F.sum("_bt").over(Window.partitionBy(series)).alias("_total"))
    return (pts.withColumn("_local", local).join(tot, [series, "_b"])
            .select(series, order, value,
                    F.try_divide(F.col("_local") + F.col("_off"), F.col("_total")).alias("cum_share")))


def curvature_elbow(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """per series, the position after the minimum second difference
    (x[i] - 2 x[i-1] + x[i-2]); first on ties."""
    w = Window.partitionBy(series).orderBy(order)
    d2 = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
    # the elbow is the point between the two differences: the middle one
    withd = df.withColumn("_d2", d2).withColumn("_mid", F.lag(order, 1).over(w)) \
        .where(F.col("_d2").isNotNull())
    return withd.groupBy(series).agg(
        F.min_by("_mid", F.struct("_d2", "_mid")).alias("elbow"),
        F.min("_d2").alias("min_second_difference"))


def argmax_first(df: DataFrame, group: list[str], score: str, k: str) -> DataFrame:
    """per group, the k with the highest score, smallest k on ties."""
    return df.where(F.col(score).isNotNull()).groupBy(*group).agg(
        F.min_by(k, F.struct((-F.col(score)).alias("_s"), F.col(k).alias("_k"))).alias(f"best_{k}"),
        F.max(score).alias(f"best_{score}"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """F8: the first n rows by ``order`` (a TakeOrderedAndProject, not a full sort)."""
    return df.orderBy(*order).limit(n)


# ---------------------------------------------------------------- sets

def distinct_union(*dfs: DataFrame) -> DataFrame:
    """Union then distinct."""
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """E15."""
    return df.select(col).distinct()
