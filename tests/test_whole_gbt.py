"""Boosted trees over cells of all rows against Spark's trainer over the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from phonon.operators import train as TR
from phonon.operators import whole_gbt as WG
from phonon.operators.explain import tree_tables

NAMES = ["a", "b", "c"]


def frame(spark, n=1500, seed=0, few=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.integers(0, 20)), float(rng.integers(0, 6)) / 7
        c = float(rng.integers(0, 30)) if few else float(rng.normal())
        rows.append((i, a, b, c, float(np.sin(a / 3) + b * c / 9 + rng.normal() / 5)))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(
        spark.createDataFrame(rows, "id long, a double, b double, c double, label double")).repartition(5)


@pytest.mark.parametrize("make", [lambda: TR.gradient_boosting(6), lambda: TR.boosted_trees(4, 5)])
def test_equals_sparks_trainer_on_all_rows(spark, make):
    df = frame(spark)
    got = WG.WholeGBT(make()).fit(df)
    both = got.transform(df).select("id", F.col("prediction").alias("p")).join(
        make().fit(df).transform(df).select("id", "prediction"), "id").collect()
    assert len(both) == 1500 and max(abs(r.p - r.prediction) for r in both) < 1e-9
    trees, _ = tree_tables(spark, got)
    assert all(t["cover"][0] == 1500 for t in trees)
    want, _ = tree_tables(spark, make().fit(df))
    assert [sorted(t["cover"]) for t in trees[:2]] == [sorted(t["cover"]) for t in want[:2]]


def test_models_of_feature_sets_share_their_passes(spark):
    df = frame(spark, 600)
    sets = [[0, 1, 2], [0], [1, 2]]
    models = WG.fit_gbt(df, [TR.boosted_trees(3, 3)] * 3, sets)
    for u, m in zip(sets, models, strict=True):
        alone = VectorAssembler(inputCols=[NAMES[k] for k in u], outputCol="features").transform(df.drop("features"))
        want = TR.boosted_trees(3, 3).fit(alone).transform(alone).select("id", "prediction")
        both = m.transform(df).select("id", F.col("prediction").alias("p")).join(want, "id").collect()
        assert max(abs(r.p - r.prediction) for r in both) < 1e-9


def test_split_points_come_from_all_rows(spark):
    df = spark.createDataFrame([(float(i % 3), float(i)) for i in range(20_000)] + [(77.0, 1e6)], "x0 double, x1 double")
    few, many = WG.split_points(df.repartition(4), ["x0", "x1"])
    assert few.tolist() == [0.5, 1.5, 39.5]              # a value of one row of 20001 has its threshold
    assert len(many) == 31 and np.allclose(many, np.arange(1, 32) / 32 * 20_000, atol=20)


def test_no_rows_is_an_error_and_a_missing_label_is_left_out(spark):
    df = frame(spark, 50)
    with pytest.raises(ValueError):
        WG.WholeGBT(TR.gradient_boosting(2)).fit(df.where("id < 0"))
    got = WG.WholeGBT(TR.gradient_boosting(2)).fit(df.withColumn("label", F.when(F.col("id") > 9, F.col("label"))))
    assert tree_tables(spark, got)[0][0]["cover"][0] == 40
