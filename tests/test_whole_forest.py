"""The forest on all rows against Spark's trees over the rows."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from phonon.operators import boosting as BO
from phonon.operators import train as TR
from phonon.operators import whole_forest as WF
from test_whole_gbt import frame


@pytest.mark.parametrize("depth", [3, 30])
def test_a_tree_without_bootstrap_is_sparks_tree(spark, depth):
    df = frame(spark, 900)
    ask = frame(spark, 300, 1) if depth == 3 else df       # equal gains of few rows are split either way
    got = WF.WholeForest(TR.random_forest(1, depth).setBootstrap(False)).fit(df).transform(ask)
    want = DecisionTreeRegressor(maxDepth=depth).fit(df).transform(ask).select("id", F.col("prediction").alias("p"))
    both = got.join(want, "id").collect()
    assert len(both) == ask.count() and max(abs(r.p - r.prediction) for r in both) < 1e-9


def test_forest_predicts_as_sparks_forest_does(spark):
    df, ask = frame(spark, 800), frame(spark, 300, 1)
    got = TR.over_all_rows(TR.random_forest(20)).fit(df).transform(ask).select("id", "prediction")
    want = TR.random_forest(20).fit(df).transform(ask).select("id", F.col("prediction").alias("p"))
    r = got.join(want, "id").agg(F.avg(F.abs(F.col("p") - F.col("prediction"))).alias("d"), F.stddev("p").alias("s"),
                                 F.count(F.lit(1)).alias("n")).first()
    assert r["n"] == 300 and r["d"] < 0.15 * r["s"]


def test_parts_and_files_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 32, (700, 3)).astype(np.uint8), rng.normal(size=700)
    weight, one, two = rng.poisson(1.0, 700).astype(np.uint8), np.zeros(700), np.zeros(700)
    WF.tree_means(x, y, weight, x, 30, one)
    own = {}                                         # grown to the end: equal rows of the draw give their mean
    for r, v, w in zip(x, y, weight, strict=True):
        own.setdefault(r.tobytes(), []).extend([v] * int(w))
    assert all(abs(p - np.mean(own[r.tobytes()])) < 1e-9 for r, p in zip(x, one, strict=True) if own[r.tobytes()])
    monkeypatch.setattr(BO, "PART_ROWS", 64)
    monkeypatch.setattr(BO, "IN_MEMORY", 64)
    monkeypatch.setattr(WF, "GROUP_NODES", 5)
    WF.tree_means(x, y, weight, x, 30, two)
    assert np.allclose(one, two, atol=1e-9)
