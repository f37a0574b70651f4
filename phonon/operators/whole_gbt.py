"""Spark's boosted trees fitted on all rows, in shared passes over equal binned rows.

The split points come from all rows: every distinct value of a feature with at
most ``BINS`` of them (midpoints between neighbours), else its percentiles. Squared error needs no
more of the rows than the weight and mean label of every cell of equal binned rows, so
``boosting.fit_shared`` over the cells grows the trees that Spark's trainer grows over the rows: the first
fits the label, the others twice the residual, weighted by the step. The result is a
``GBTRegressionModel``, written in Spark's stored form and loaded, so it scores, saves and is explained as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonon.session import scratch_path, ship_package

from . import boosting as BO

NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
         "rawCount long, gain double, leftChild int, rightChild int, "
         "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def split_points(rows: DataFrame, names: list[str], bins: int = BO.BINS) -> list[np.ndarray]:
    """Thresholds of every column from all rows; a value up to a threshold is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0) for _ in names]
        for batch in batches:
            for k in range(len(names)):
                if len(seen[k]) <= bins:
                    seen[k] = np.union1d(seen[k], batch.column(k).to_numpy(zero_copy_only=False))[:bins + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(names)), [len(v) for v in seen]), pa.int32()),
             pa.array(np.concatenate(seen) if seen else np.zeros(0), pa.float64())], names=["feature", "value"])

    ship_package(rows.sparkSession)
    few = {r["feature"]: r["v"] for r in rows.select(*names).mapInArrow(run, "feature int, value double")
           .groupBy("feature").agg(F.slice(F.array_sort(F.collect_set("value")), 1, bins + 1).alias("v")).collect()}
    many = [k for k, v in few.items() if len(v) > bins]
    out = {k: (np.array(v[:-1]) + np.array(v[1:])) / 2 for k, v in few.items() if len(v) <= bins}
    if many:
        at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        got = rows.agg(*[F.percentile_approx(names[k], at, 10_000).alias(f"c{k}") for k in many]).first()
        out |= {k: np.unique(np.asarray(got[f"c{k}"], float)) for k in many}
    return [out.get(k, np.zeros(0)) for k in range(len(names))]


def flat_rows(rows: DataFrame, regressor: GBTRegressor | RandomForestRegressor) -> tuple[DataFrame, BO.Binning]:
    """(rows with a label as columns x0, x1, ... and y, stored; their binning)."""
    vector = vector_to_array(regressor.getFeaturesCol())
    head = rows.select(vector.alias("v")).first()
    if head is None:
        raise ValueError("no rows to fit on")
    names = [f"x{k}" for k in range(len(head["v"]))]
    label = F.col(regressor.getLabelCol()).cast("double")
    flat = BO._stored(rows.select(vector.alias("v"), label.alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
                      .select(*[F.col("v")[k].alias(c) for k, c in enumerate(names)], "y"), "flat")
    return flat, BO.Binning(names, split_points(flat, names), [0.0] * len(names))


def fit_gbt(rows: DataFrame, regressors: list[GBTRegressor], usable: list[list[int]] | None = None
            ) -> list[GBTRegressionModel]:
    """One model a regressor, all grown at once on all ``rows`` (their ``features`` and ``label`` columns).

    ``usable``: the features (by their place in the vector) each model may split on. Rows without a label are
    left out. Depth, rounds and step are the regressors'; one row is enough for a leaf, as in Spark's default.
    """
    spark = rows.sparkSession
    flat, binning = flat_rows(rows, regressors[0])
    names, cuts = binning.features, binning.cuts
    blocks = BO._stored(BO.cell_blocks(BO.cells(flat, binning, "y", F.lit(0), 1)), "cells")
    settings = [BO.Settings(rounds=r.getMaxIter(), step=2 * r.getStepSize(), depth=r.getMaxDepth(), l2=0.0)
                for r in regressors]
    masks = None if usable is None else [np.isin(np.arange(len(names)), u) for u in usable]
    fits = BO.fit_shared(blocks, len(names), [(s, None) for s in settings], first_step=1.0, usable=masks)
    return [spark_model(spark, r, base, trees, cuts) for r, (base, trees) in zip(regressors, fits, strict=True)]


def spark_model(spark: SparkSession, regressor: GBTRegressor, base: float, trees: list[BO.Tree],
                cuts: list[np.ndarray]) -> GBTRegressionModel:
    """The trees as Spark's model. Weights and gains of nodes are set; impurities are not known (NaN)."""
    step, rows = regressor.getStepSize(), []
    for number, t in enumerate(trees):
        value = base + t.value if number == 0 else t.value / step
        scale = 1.0 if number == 0 else 4.0                   # later trees fit twice the residual
        for k in range(len(t.feature)):
            f, cover = int(t.feature[k]), float(t.cover[k])
            split = (f, [float(cuts[f][t.bin[k]])], -1) if f >= 0 else (-1, [], -1)
            rows.append((number, (
                k, float(value[k]), float("nan"), [cover, cover * float(value[k]), float("nan")], round(cover),
                scale * float(t.gain[k]) / cover if f >= 0 else -1.0,
                int(t.left[k]) if f >= 0 else -1, int(t.left[k]) + 1 if f >= 0 else -1, split)))
    path = scratch_path(spark, f"gbt/{uuid.uuid4().hex}")
    params = {"featuresCol": regressor.getFeaturesCol(), "labelCol": regressor.getLabelCol(),
              "predictionCol": regressor.getPredictionCol(), "maxDepth": regressor.getMaxDepth(),
              "seed": regressor.getSeed(), "impurity": regressor.getImpurity()}

    def about(cls: str, uid: str, more: dict) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{cls}", "timestamp": 0,
                           "sparkVersion": spark.version, "uid": uid, "defaultParamMap": {}, **more})

    meta = about("GBTRegressionModel", regressor.uid, {
        "paramMap": params | {"maxIter": regressor.getMaxIter(), "stepSize": step},
        "numFeatures": len(cuts), "numTrees": len(trees)})
    each = [(k, about("DecisionTreeRegressionModel", f"{regressor.uid}_{k}", {"paramMap": {
        "maxDepth": regressor.getMaxDepth(), "impurity": regressor.getImpurity()}}), 1.0 if k == 0 else step)
            for k in range(len(trees))]
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(rows, NODES).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return GBTRegressionModel.load(path)


class WholeGBT(Estimator):
    """A ``GBTRegressor`` whose fit takes all rows through ``fit_gbt``."""

    def __init__(self, regressor: GBTRegressor) -> None:
        super().__init__()
        self.regressor = regressor

    def _fit(self, df: DataFrame) -> GBTRegressionModel:
        return fit_gbt(df, [self.regressor])[0]
