"""Regressors, evaluation, comparison, search, importance, scoring.

Training is ``pyspark.ml``: a ``Pipeline`` of VectorAssembler ->
StandardScaler -> regressor, fitted on the log1p target. Every comparison
and importance table is a DataFrame built from prediction DataFrames.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, ImputerModel, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import permute as PM
from .explain import tree_tables
from .explore import evaluate_log_and_original, histogram, regression_metrics
from .kernel import KernelRegression
from .whole_forest import WholeForest
from .whole_gbt import WholeGBT, fit_gbt


# ---------------------------------------------------------------- trainers

def random_forest(n_trees: int = 100, max_depth: int = 30, seed: int = 42):
    """100 trees, every feature considered at each split. The reference's
    trees have no depth bound; 30 is the deepest Spark grows."""
    return RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, featureSubsetStrategy="all",
                                 seed=seed, featuresCol="features", labelCol="label")


def gradient_boosting(n_iter: int = 100, max_depth: int = 3, step: float = 0.1, seed: int = 42):
    """Boosted trees with the classic library defaults."""
    return GBTRegressor(maxIter=n_iter, maxDepth=max_depth, stepSize=step, seed=seed,
                        featuresCol="features", labelCol="label")


def boosted_trees(n_iter: int = 100, max_depth: int = 6, step: float = 0.3, seed: int = 42):
    """The second boosted-tree configuration (deeper, larger steps)."""
    return GBTRegressor(maxIter=n_iter, maxDepth=max_depth, stepSize=step, seed=seed,
                        featuresCol="features", labelCol="label")


def over_all_rows(regressor: GBTRegressor | RandomForestRegressor) -> WholeGBT | WholeForest:
    """The regressor, its trees grown on all rows (``whole_gbt``, ``whole_forest``)."""
    return WholeForest(regressor) if isinstance(regressor, RandomForestRegressor) else WholeGBT(regressor)


def huber_linear():
    """Robust linear model, beside the kernel one."""
    return LinearRegression(loss="huber", featuresCol="features", labelCol="label")


def kernel_regression(n_features: int = 256, seed: int = 42) -> KernelRegression:
    """Epsilon-insensitive regression with the radial kernel (random Fourier features)."""
    return KernelRegression(n_features, seed=seed)


def default_trainers() -> dict:
    """Makers of the compared regressors; all take all rows."""
    return {"random_forest": lambda: over_all_rows(random_forest()),
            "gradient_boosting": lambda: over_all_rows(gradient_boosting()),
            "boosted_trees": lambda: over_all_rows(boosted_trees()), "kernel_regression": kernel_regression,
            "huber_linear": huber_linear}


FIT_PART_ROWS = 50_000


def median_imputer(features: list[str]) -> Imputer:
    """Missing values (NULL or NaN) -> the column's median over the rows it is
    fitted on. It writes beside the inputs, which stay as they came."""
    return Imputer(strategy="median", inputCols=features,
                   outputCols=[f"_imputed_{i}" for i in range(len(features))])


def bounded_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``key``: the stated
    bound on the labelled rows that a regressor takes (medians, scales and power
    transforms, scoring and tables cover all rows)."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) < F.lit(
        int(most / n * (1 << 30))))


def regression_pipeline(features: list[str], regressor, scale: bool = True) -> Pipeline:
    """Impute (median of the training rows), assemble, scale, regress: one fitted
    pipeline, saved and applied as a whole."""
    imputer = median_imputer(features)
    stages = [imputer, VectorAssembler(inputCols=imputer.getOutputCols(),
                                       outputCol="_raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages + [regressor])


# ---------------------------------------------------------------- fit and evaluate

def with_log_label(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.log1p(target))


def prepared_rows(train: DataFrame, features: list[str], target: str, scale: bool = True,
                  key: str | None = None, fit_rows: int | None = None) -> tuple[list, DataFrame]:
    """(fitted stages before the regressor, the rows it takes): see ``fit_regression``.

    Bounded rows are stored, so that the many short jobs of a fit do not read all of ``train`` again.
    """
    rows, fitted = with_log_label(train, target), []
    for stage in regression_pipeline(features, None, scale).getStages()[:-1]:
        model = stage.fit(rows) if hasattr(stage, "fit") else stage
        rows, fitted = model.transform(rows), [*fitted, model]
    if fit_rows is not None:
        spark = train.sparkSession
        path = scratch_path(spark, f"fit/{uuid.uuid4().hex}")
        bounded_rows(rows, key, fit_rows).select("features", "label").write.parquet(path)
        rows = spark.read.schema(rows.select("features", "label").schema).parquet(path).coalesce(
            -(-fit_rows // FIT_PART_ROWS))
    return fitted, rows


def fit_regression(regressor, train: DataFrame, features: list[str], target: str, scale: bool = True,
                   key: str | None = None, fit_rows: int | None = None) -> PipelineModel:
    """Fitted pipeline on log1p(target). Medians, means and scales come from all rows of ``train``;
    with ``fit_rows`` the regressor alone takes about that many rows, by a hash of ``key``."""
    fitted, rows = prepared_rows(train, features, target, scale, key, fit_rows)
    return PipelineModel([*fitted, regressor.fit(rows)])


def train_and_evaluate(regressor, train: DataFrame, test: DataFrame, features: list[str],
                       target: str, scale: bool = True, key: str | None = None,
                       fit_rows: int | None = None):
    """Fit on log1p(target), score test; metrics on both scales."""
    model = fit_regression(regressor, train, features, target, scale, key, fit_rows)
    pred = model.transform(with_log_label(test, target))
    metrics = evaluate_log_and_original(pred, "label", "prediction", target)
    return model, metrics, pred


def train_and_evaluate_sets(regressor: GBTRegressor, train: DataFrame, test: DataFrame,
                            sets: dict[str, list[str]], target: str) -> dict[str, DataFrame]:
    """J19 for several feature sets: a model a set on all rows of ``train``, grown in shared passes.

    Imputer and scaler work column by column and are fitted once on the columns of all sets.
    """
    columns = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    fitted, rows = prepared_rows(train, columns, target)
    models = fit_gbt(rows, [regressor] * len(sets), [[columns.index(c) for c in cols] for cols in sets.values()])
    ready = PipelineModel(fitted).transform(with_log_label(test, target)).select("features", "label", target)
    return {name: evaluate_log_and_original(m.transform(ready), "label", "prediction", target)
            for name, m in zip(sets, models, strict=True)}


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """One row per model with R2/MAE/RMSE on the log and original scale."""
    parts = [m.withColumn("model", F.lit(name)) for name, m in results.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.select("model", "scale", "r2", "mae", "rmse")
    return (long.groupBy("model").pivot("scale", ["log", "original"])
            .agg(F.first("r2").alias("r2"), F.first("mae").alias("mae"), F.first("rmse").alias("rmse")))


def model_grid(train: DataFrame, test: DataFrame, features: list[str], target: str,
               trainers: dict, transforms: dict | None = None, key: str | None = None,
               fit_rows: int | None = None) -> DataFrame:
    """Trainers x preprocessing variants -> one comparison table.

    ``transforms`` maps a variant name to fn(train, test) -> (train, test)
    (e.g. the Yeo-Johnson power transform); the default is scaling only.
    """
    transforms = transforms or {"scaled": lambda a, b: (a, b)}
    train, test = train.cache(), test.cache()
    results = {}
    for tname, tf in transforms.items():
        tr, te = tf(train, test)
        # imputer and scaler are fitted once a variant, for all trainers
        fitted, rows = prepared_rows(tr, features, target, key=key, fit_rows=fit_rows)
        if fit_rows is None:               # read by every trainer
            path, kept = scratch_path(train.sparkSession, f"fit/{uuid.uuid4().hex}"), rows.select("features", "label")
            kept.write.parquet(path)
            rows = train.sparkSession.read.schema(kept.schema).parquet(path)
        ready = PipelineModel(fitted).transform(with_log_label(te, target)).select("features", "label", target).cache()
        for name, make in trainers.items():
            metrics = evaluate_log_and_original(make().fit(rows).transform(ready), "label", "prediction", target)
            # two rows of numbers per model; the cached frames can then go
            results[f"{name}|{tname}"] = train.sparkSession.createDataFrame(
                metrics.collect(), metrics.schema)
        ready.unpersist()
    train.unpersist()
    test.unpersist()
    table = compare_models(results)
    parts = F.split("model", r"\|")
    return table.withColumns({"model": parts[0], "preprocessing": parts[1]})


# ---------------------------------------------------------------- importance

def feature_importance(model: PipelineModel, features: list[str], top: int | None = None) -> DataFrame:
    """The tree model's impurity importances, largest first (name breaks
    ties); only the ``top`` first if given."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray()
    df = SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                           "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(top) if top else df


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(``df`` with dense row numbers 0 .. n-1 in ``name``, n), stored once.

    Rows are numbered where they lie; a stored file's rows are shifted by the
    counts of the files before it, one row a task. No sort, no shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"numbered/{uuid.uuid4().hex}")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(df.withColumn(name, F.lit(0).cast("long")).schema).parquet(path)
    part = F.shiftright(name, 33)
    starts, total = [], 0
    for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r["p"], total - (r["p"] << 33)))
        total += r["n"]
    shift = spark.createDataFrame(starts, "_part long, _shift long")      # one row a task
    return (rows.withColumn("_part", part).join(F.broadcast(shift), "_part")
            .withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift")), total


WALK = 64


def feistel(i: Column, n: int, key: Column, rounds: int = 4) -> Column:
    """A keyed permutation of 0 .. n-1 as a column expression, without sorting.

    The number is split into a pair (x, y) of a grid just over n; each round adds a hash of one half
    to the other, which is a bijection of the grid. Results beyond n are put through again (cycle
    walking). Fewer than sqrt(n) + 1 cells lie beyond n, so above n = 4096 WALK steps are missed
    with a chance below n^-30, and below it they are more than the cells.
    """
    if n < 2:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(v: Column) -> Column:
        def half(s: Column, r: Column) -> Column:
            x = F.pmod(s["x"] + F.pmod(F.xxhash64(s["y"], key, r), F.lit(a)), F.lit(a)).cast("long")
            y = F.pmod(s["y"] + F.pmod(F.xxhash64(s["x"], key, r), F.lit(b)), F.lit(b)).cast("long")
            return F.when(r % 2 == 0, F.struct(x.alias("x"), s["y"].alias("y"))).otherwise(
                F.struct(s["x"].alias("x"), y.alias("y")))

        start = F.struct((v % a).cast("long").alias("x"), F.floor((v - v % a) / a).cast("long").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, half, lambda s: s["y"] * a + s["x"])

    steps = F.sequence(F.lit(1), F.lit(min(a + 1, WALK)))
    return F.aggregate(steps, once(i.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def permute_column(df: DataFrame, col: str, seed: int) -> DataFrame:
    """``df`` with the values of ``col`` moved between rows by one permutation of the whole column."""
    rows, n = numbered(df, "_i")
    donors = rows.select(F.col("_i").alias("_j"), F.col(col).alias("_v"))
    return (rows.withColumn("_j", feistel(F.col("_i"), n, F.lit(seed))).join(donors, "_j")
            .withColumn(col, F.col("_v")).drop("_i", "_j", "_v"))


def permutation_importance(model: PipelineModel, test: DataFrame, features: list[str], target: str,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean drop in R2 (log scale) when one feature is shuffled.

    One numbering serves all features and repeats; only the moved values travel (``permute.trials``).
    Small trees behind column-wise stages are scored where the values arrive, other models
    on all rows x features x repeats.
    """
    rows, n = numbered(with_log_label(test, target).select(
        *[F.col(f).cast("double").alias(f) for f in features], "label"), "_i")
    base = regression_metrics(model.transform(rows), "label", "prediction").first().r2
    spread = rows.agg(F.var_pop("label") * F.count("label")).first()[0]
    keys = [[F.xxhash64(F.lit(seed), F.lit(f), F.lit(r)) for r in range(repeats)] for f in features]
    trees = _small_trees(model, features)
    if trees:
        ready = PipelineModel(model.stages[:-1]).transform(rows).select(
            "_i", vector_to_array(model.stages[-1].getFeaturesCol()).alias("x"), "label")
        tried = PM.trials(ready, n, len(features), keys, PM.TreeTables(trees, len(features)))
    else:
        ready = rows.select("_i", F.array(*features).alias("x"), "label")
        tried = PM.trials(ready, n, len(features), keys, None)
        pred = model.transform(tried.select("trial", *[F.col("x")[i].alias(f) for i, f in enumerate(features)], "label"))
        error = F.col("label") - F.col("prediction")
        tried = pred.select("trial", (error * error).alias("sse"))
    r2 = 1 - F.sum("sse") / F.lit(spread).cast("double")
    per = tried.groupBy("trial").agg((F.lit(base).cast("double") - r2).alias("drop"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.floor(F.col("trial") / repeats).cast("int") + 1)
    return (per.groupBy(name.alias("feature")).agg(F.avg("drop").alias("importance"),
                                                   F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("std"))
            .orderBy(F.col("importance").desc(), "feature"))


def _small_trees(model: PipelineModel, features: list[str]) -> list[dict] | None:
    """The trees of a ``regression_pipeline`` over ``features``; None for other models and larger trees."""
    *stages, last = model.stages
    kinds = [type(s) for s in stages]
    if kinds not in ([ImputerModel, VectorAssembler], [ImputerModel, VectorAssembler, StandardScalerModel]) or not \
            isinstance(last, (GBTRegressionModel, RandomForestRegressionModel)) or last.getMaxDepth() > PM.MOST_DEPTH:
        return None
    if stages[0].getInputCols() != features or stages[1].getInputCols() != stages[0].getOutputCols():
        return None
    return tree_tables(SparkSession.getActiveSession(), last)[0]


# ---------------------------------------------------------------- tables behind plots

def parity_table(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row from one aggregate: plot bounds (min/max over both
    columns), MAE, RMSE, R2, n."""
    from .explore import metric_aggs
    pairs = pred.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return pairs.agg(F.least(F.min(actual), F.min(predicted)).alias("lower"),
                     F.greatest(F.max(actual), F.max(predicted)).alias("upper"),
                     *metric_aggs(actual, predicted))


def residual_histogram(pred: DataFrame, actual: str, predicted: str, bins: int = 30) -> DataFrame:
    """Histogram of actual - predicted."""
    from ..functions.numeric import residual
    r = pred.select(residual(actual, predicted).alias("residual"))
    return histogram(r, ["residual"], bins)


# ---------------------------------------------------------------- artifacts (A10)

def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------- batch scoring

def score_batch(model: PipelineModel, df: DataFrame, features: list[str],
                out_col: str = "predicted_thermal_conductivity_W_mK", raw_target: bool = False,
                digits: int = 3) -> DataFrame:
    """Align features (B8), impute (the model's medians), predict, bring
    back from log1p (B14), round half-to-even (H7). Input columns are carried
    through as they came; a missing feature column is 0, a missing value in a
    present one is the training median."""
    from .explore import decide_scale
    keep = [c for c in df.columns if c not in features]
    aligned = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) if c in df.columns
                                 else F.lit(0.0).alias(c) for c in features])
    pred = model.transform(aligned)
    pred = decide_scale(pred, "prediction", out_col, raw_target=raw_target)
    from ..functions.numeric import round_half_even
    return pred.withColumn(out_col, round_half_even(out_col, digits)).select(*df.columns, out_col)
