"""Permutation importance over packed blocks (J24) against one join a trial."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from phonon.operators import permute as PM
from phonon.operators import train as TR
from phonon.operators.explore import regression_metrics

FEATURES = ["x", "z", "noise"]


def table(spark, n):
    """Missing features and targets, repeated values, cut into uneven parts."""
    rows = [(None if i % 17 == 0 else float(i % 50), float((i * 7919) % 1009) / 10,
             float("nan") if i % 29 == 0 else float((i * 7) % 13),
             None if i % 23 == 0 else (i % 50) * 100.0 + (i * 7919) % 1009 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "x double, z double, noise double, y double").repartition(5).cache()


def by_joins(model, df, repeats, seed=42):
    """{feature: (mean, std) of the drops}, a join and a scoring a trial, on the numbering ``rows``."""
    rows, n = df
    base = regression_metrics(model.transform(rows), "label", "prediction").first().r2
    out = {}
    for f in FEATURES:
        drops = []
        for r in range(repeats):
            key = F.xxhash64(F.lit(seed), F.lit(f), F.lit(r))
            donors = rows.select(F.col("_i").alias("_j"), F.col(f).alias("_v"))
            moved = rows.withColumn("_j", TR.feistel(F.col("_i"), n, key)).join(donors, "_j").withColumn(f, F.col("_v"))
            drops.append(base - regression_metrics(model.transform(moved), "label", "prediction").first().r2)
        out[f] = (np.mean(drops), np.std(drops, ddof=1) if repeats > 1 else 0.0)
    return out


@pytest.mark.parametrize("make,repeats", [(lambda: TR.gradient_boosting(10), 2), (lambda: TR.random_forest(4, 3), 1),
                                          (lambda: TR.random_forest(3, 6), 2),
                                          (lambda: LinearRegression(featuresCol="features", labelCol="label"), 2)])
def test_importance_equals_one_join_a_trial(spark, monkeypatch, make, repeats):
    monkeypatch.setattr(PM, "LEAST_ROWS", 100)
    df = table(spark, 3001)
    model = TR.fit_regression(make(), df.where("y IS NOT NULL"), FEATURES, "y")
    kept = []
    numbered = TR.numbered
    monkeypatch.setattr(TR, "numbered", lambda d, name: kept.append(numbered(d, name)) or kept[-1])
    got = {r.feature: (r.importance, r["std"])
           for r in TR.permutation_importance(model, df, FEATURES, "y", repeats=repeats).collect()}
    want = by_joins(model, kept[0], repeats)
    assert set(got) == set(want) and want["x"][0] > 0.1
    for f in FEATURES:
        assert np.allclose(got[f], want[f], rtol=1e-9, atol=1e-12)


def test_importance_multiplies_no_rows(spark):
    """Only packed values travel: no row is repeated for a trial and no trial is joined or sorted."""
    df = table(spark, 500)
    model = TR.fit_regression(TR.gradient_boosting(3), df.where("y IS NOT NULL"), FEATURES, "y")
    plan = TR.permutation_importance(model, df, FEATURES, "y")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_importance_of_few_rows(spark):
    df = table(spark, 200)
    model = TR.fit_regression(TR.gradient_boosting(3), df.where("y IS NOT NULL"), FEATURES, "y")
    assert TR.permutation_importance(model, df.where("z < 0"), FEATURES, "y").collect() == []
    unlabelled = TR.permutation_importance(model, df.where("y IS NULL"), FEATURES, "y").collect()
    assert [r.feature for r in unlabelled] == sorted(FEATURES) and all(r.importance is None for r in unlabelled)
    two = TR.permutation_importance(model, df.where("y IS NOT NULL").orderBy("y").limit(2), FEATURES, "y").collect()
    assert len(two) == 3 and all(math.isfinite(r.importance) for r in two)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 101, 4099, 20_001])
def test_numbers_move_as_by_feistel_and_back(spark, n):
    keys = [F.xxhash64(F.lit(42), F.lit("f"), F.lit(r)) for r in range(2)]
    steps = PM.round_tables(spark, n, keys)
    want = spark.range(n).select("id", *[TR.feistel(F.col("id"), n, k).alias(f"s{i}") for i, k in enumerate(keys)]).toPandas()
    for i in range(2):
        to = PM.moved(want["id"].to_numpy(), n, steps[i])
        assert (to == want[f"s{i}"].to_numpy()).all()
        assert (PM.moved(to, n, steps[i], back=True) == want["id"].to_numpy()).all()
