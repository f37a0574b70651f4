"""Preparation for modelling.

Every "fit" here is one aggregate over the training rows whose result is a
handful of numbers per column (means, medians, scales, lambdas, category
lists, drop lists); "transform" applies them as column expressions, so the
data itself never leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .explore import column_stats, correlation_pairs, null_columns, numeric_columns
from .quantiles import exact_quantiles

# Non-feature columns excluded from the numeric feature list.
NON_FEATURES = ["formula", "source", "composition_obj", "crystal_system", "mp_spacegroup"]


# ---------------------------------------------------------------- imputation

def fit_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def fill_with(df: DataFrame, values: dict[str, float | None], default: float | None = None) -> DataFrame:
    """Replace NULLs by fitted values (``default`` when a fitted value is missing)."""
    exprs = {}
    for c, v in values.items():
        v = default if v is None else v
        exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) if v is not None \
            else F.col(c).cast("double")
    return df.withColumns(exprs)


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean imputation (all-NULL columns stay NULL; drop them first, C6)."""
    return fill_with(df, fit_means(df, cols))


def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians per column (``exact_quantiles`` on the long form)."""
    from .explore import to_long
    q = exact_quantiles(to_long(df, cols), "value", [0.5], ["feature"], names=["median"]).collect()
    got = {r.feature: r.median for r in q}
    return {c: got.get(c) for c in cols}


def impute_median(df: DataFrame, cols: list[str], fallback: float = 0.0) -> DataFrame:
    """Median of the batch, 0 where a column has no value at all."""
    return fill_with(df, fit_medians(df, cols), default=fallback)


# ---------------------------------------------------------------- J1

def prepare_for_modeling(df: DataFrame, target: str, exclude: list[str] = NON_FEATURES,
                         carry: list[str] = (), impute: bool = True) -> tuple[DataFrame, list[str]]:
    """Drop rows without target; numeric features minus non-features;
    all-NULL feature columns dropped; remaining NULLs mean-imputed.

    Returns (frame with ``carry`` columns, features and target; feature names).
    Training uses ``impute=False``: the saved pipeline imputes, with values
    fitted on the training rows only.
    """
    rows = df.dropna(subset=[target])
    feats = numeric_columns(rows, exclude=[target] + list(exclude) + list(carry))
    info = null_columns(rows, feats).collect()
    keep = [r.feature for r in info if not r.all_null]
    with_nulls = [r.feature for r in info if not r.all_null and r.null_count > 0]
    out = rows.select(*carry, *[F.col(f"`{c}`").cast("double").alias(c) for c in keep], target)
    if with_nulls and impute:
        out = impute_mean(out, with_nulls)
    return out, keep


# ---------------------------------------------------------------- split

def hash_bucket(key: Column | str, buckets: int = 5) -> Column:
    """Stable bucket of a key: first 32 bits of md5(key as text), modulo ``buckets``.

    Independent of partitioning and of row order, so the same row always
    lands on the same side, on any cluster.
    """
    k = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint")
            % buckets).cast("int")


def split_train_test(df: DataFrame, key: str, test_fraction_buckets: int = 1,
                     buckets: int = 5) -> tuple[DataFrame, DataFrame]:
    """80/20 (by default) split by key hash."""
    b = hash_bucket(key, buckets)
    return df.where(b >= test_fraction_buckets), df.where(b < test_fraction_buckets)


# ---------------------------------------------------------------- scaling

def fit_standard_scaler(df: DataFrame, cols: list[str], ddof: int = 1) -> dict[str, tuple]:
    """(mean, std) per column; ddof=0 gives the population std of scikit-learn."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[std(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_standard_scaler(df: DataFrame, params: dict[str, tuple]) -> DataFrame:
    """z-score; a zero or missing std leaves the centred value (as scikit-learn)."""
    exprs = {}
    for c, (m, s) in params.items():
        centred = F.col(c) - F.lit(m)
        exprs[c] = centred / F.lit(s) if s not in (None, 0.0) and not math.isnan(s) else centred
    return df.withColumns(exprs)


# ---------------------------------------------------------------- Yeo-Johnson

def yeo_johnson(c: Column | str, lmbda: float) -> Column:
    """The Yeo-Johnson transform at a fixed lambda, as a column expression."""
    x = F.col(c) if isinstance(c, str) else c
    if abs(lmbda) < 1e-12:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1, F.lit(lmbda)) - 1) / lmbda
    if abs(lmbda - 2) < 1e-12:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(1 - x, F.lit(2 - lmbda)) - 1) / (2 - lmbda)
    return F.when(x >= 0, pos).otherwise(neg)


def _yeo_johnson_col(x: Column, lam: Column) -> Column:
    """Yeo-Johnson with lambda given per row (a column)."""
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def _yeo_johnson_value(x: float, lam: float) -> float:
    try:
        if x >= 0:
            return math.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
        return -math.log1p(-x) if abs(lam - 2) < 1e-12 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
    except OverflowError:
        return math.inf


def fit_yeo_johnson(df: DataFrame, cols: list[str], start: float = 1.0, step: float = 0.5,
                    points: int = 9, tolerance: float = 1e-3, max_rounds: int = 60) -> dict[str, float]:
    """Maximum-likelihood lambda per column by a grid that moves, then narrows.

    The columns are unpivoted to (feature, value); each round is ONE
    aggregate grouped by feature that evaluates ``points`` lambdas per
    feature (joined in as columns from a d-row parameter table). The
    log-likelihood is -n/2 log(var_pop(psi)) + (lambda - 1) sum(sign(x)
    log1p|x|). While the best lambda lies on the edge of its grid, the grid
    moves there and widens; once it lies inside, the grid narrows around it.
    There is no bound on lambda. The cost is one pass a round, whatever the
    number of columns.
    """
    from .explore import to_long
    spark = df.sparkSession
    long = to_long(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # equal values once, with their count: every round reads these only
    long = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count")).persist()
    base = {r.feature: (r.n, r.t or 0.0, r.mean) for r in long.groupBy("feature").agg(
        F.sum("count").alias("n"),
        F.sum(F.col("count") * F.signum("value") * F.log1p(F.abs("value"))).alias("t"),
        (F.sum(F.col("count") * F.col("value")) / F.sum("count")).alias("mean")).collect()}
    centre = {c: start for c in cols}
    steps = {c: step for c in cols if c in base}
    half = points // 2
    for _ in range(max_rounds):
        if not steps:
            break
        grids = {c: [centre[c] + (j - half) * h for j in range(points)] for c, h in steps.items()}
        params = spark.createDataFrame(
            [(c, *g, *[_yeo_johnson_value(base[c][2], lam) for lam in g]) for c, g in grids.items()],
            "feature string, " + ", ".join(f"{a}{j} double" for a in "ls" for j in range(points)))
        joined = long.join(F.broadcast(params), "feature")  # one row per column: bounded
        # variances from values about the transformed mean, which keeps the squares short of cancellation
        apart = [_yeo_johnson_col(F.col("value"), F.col(f"l{j}")) - F.col(f"s{j}") for j in range(points)]
        total = F.sum("count")
        rows = joined.groupBy("feature").agg(*[
            (F.sum(F.col("count") * a * a) / total - F.pow(F.sum(F.col("count") * a) / total, 2)).alias(f"v{j}")
            for j, a in enumerate(apart)]).collect()
        for r in rows:
            c = r.feature
            n, t, _ = base[c]
            scores = [(-(n / 2.0) * math.log(r[f"v{j}"]) + (lam - 1) * t, -abs(lam - 1), j)
                      for j, lam in enumerate(grids[c])
                      if r[f"v{j}"] is not None and math.isfinite(r[f"v{j}"]) and r[f"v{j}"] > 0]
            if not scores:                       # constant or empty: nothing to fit
                del steps[c]
                continue
            j = max(scores)[2]
            centre[c] = grids[c][j]
            steps[c] *= 2.0 if j in (0, points - 1) else 2.0 / (points - 1)
            if steps[c] < tolerance:
                del steps[c]
    long.unpersist()
    return centre


def power_transform(train: DataFrame, test: DataFrame, cols: list[str]):
    """Yeo-Johnson with lambdas fitted on train, then z-score (fitted on train)."""
    lambdas = fit_yeo_johnson(train, cols)
    t_train = train.withColumns({c: yeo_johnson(c, lambdas[c]) for c in cols})
    t_test = test.withColumns({c: yeo_johnson(c, lambdas[c]) for c in cols})
    params = fit_standard_scaler(t_train, cols, ddof=0)
    return apply_standard_scaler(t_train, params), apply_standard_scaler(t_test, params), lambdas


# ---------------------------------------------------------------- one-hot

def fit_categories(df: DataFrame, col: str, max_categories: int = 10_000) -> list:
    """Sorted distinct non-null values; more than ``max_categories`` is an error."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, categories: list, prefix: str = "cluster") -> DataFrame:
    """One 0/1 column per fitted category; an unseen value gives all zeros."""
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("double")
                           for v in categories}).withColumns(
        {f"{prefix}_{v}": F.coalesce(F.col(f"{prefix}_{v}"), F.lit(0.0)) for v in categories})


# ---------------------------------------------------------------- feature selection

# Thresholds of the feature selection.
MISSING_THRESH, MIN_STD, CORR_THRESH = 0.3, 1e-5, 0.85


def features_to_drop(df: DataFrame, cols: list[str], missing_thresh: float = MISSING_THRESH,
                     min_std: float = MIN_STD, corr_thresh: float = CORR_THRESH) -> DataFrame:
    """J20 decision table: distinct features to drop, as a DataFrame.

    (1) missing fraction > missing_thresh; (2) sample std < min_std (the
    reference compares the std, N10); (3) among the rest, a column whose
    |corr| with any EARLIER remaining column exceeds corr_thresh.
    Two passes over the data: per-column statistics, then the correlations
    of the surviving columns only. The decision itself runs on those few
    numbers, like any fit.
    """
    st = column_stats(df, cols)
    drop12 = [c for c in cols
              if (st[c]["missing"] is not None and st[c]["missing"] > missing_thresh)
              or (st[c]["std"] is not None and st[c]["std"] < min_std)]
    keep = [c for c in cols if c not in drop12]
    strong = correlation_pairs(df, keep, st).where(F.abs("corr") > corr_thresh)
    high = [r[0] for r in strong.select("feature_b").distinct().collect()]   # names of columns
    drop = sorted(set(drop12) | set(high))
    return df.sparkSession.createDataFrame([(f,) for f in drop], "feature string")


def select_features(df: DataFrame, cols: list[str], **kw) -> tuple[DataFrame, list[str]]:
    """The frame without dropped features, and the drop list."""
    drop = [r.feature for r in features_to_drop(df, cols, **kw).collect()]
    return df.drop(*drop), sorted(drop)
