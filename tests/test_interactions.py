"""Interaction values of tree ensembles against a brute force over coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonon.operators import explain as XP
from phonon.operators import train as TR


def worth(x, leaves, coalition):
    """Value of a coalition: features in it are known, the others count by their cover shares."""
    total = 0.0
    for leaf in leaves:
        v = leaf["value"]
        for f, lo, hi, z in zip(leaf["features"], leaf["low"], leaf["high"], leaf["share"], strict=True):
            v *= float(lo < x[f] <= hi) if f in coalition else z
        total += v
    return total


def brute(x, leaves, i, j):
    n = len(x)
    rest = [f for f in range(n) if f not in (i, j)]
    total = 0.0
    for size in range(len(rest) + 1):
        for s in itertools.combinations(rest, size):
            s = set(s)
            gain = worth(x, leaves, s | {i, j}) - worth(x, leaves, s | {i}) - worth(x, leaves, s | {j}) + worth(x, leaves, s)
            total += math.factorial(size) * math.factorial(n - size - 2) / (2 * math.factorial(n - 1)) * gain
    return total


def frame(spark, n=80):
    rng = np.random.default_rng(0)
    rows = [(str(i), *(float(v) for v in rng.normal(size=4))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, a double, b double, c double, d double").withColumn(
        "y", F.col("a") * F.col("b") + F.abs("c") + 5)


@pytest.mark.parametrize("make", [lambda: TR.gradient_boosting(6), lambda: TR.random_forest(5, 5)])
def test_interactions_match_coalitions_and_add_up(spark, make):
    feats = ["a", "b", "c", "d"]
    df = frame(spark)
    model = TR.fit_regression(make(), df, feats, "y")
    trees, _ = XP.tree_tables(spark, model.stages[-1])
    leaves = [leaf for t in trees for leaf in XP.leaf_boxes(t)]
    x = np.random.default_rng(1).normal(size=(6, 4))
    got = XP.batch_interactions(x, leaves)
    for r, (i, j) in itertools.product(range(6), itertools.combinations(range(4), 2)):
        assert got[r, i, j] == got[r, j, i] == pytest.approx(brute(x[r], leaves, i, j), abs=1e-10)
    phi = {(r.key, r.feature): r.phi for r in XP.shap_values(model, df, "k", feats).collect()}
    # blocks of leaves give the same values
    small = {(r.key, r.feature): r.phi for r in XP.shap_values(model, df, "k", feats, block_leaves=7).collect()}
    assert small == pytest.approx(phi, abs=1e-9)
    pairs = XP.shap_interactions(model, df, "k", feats, block_leaves=20).cache()
    sums = pairs.groupBy("key", "feature").agg(F.sum("phi").alias("phi")).collect()
    assert {(r.key, r.feature): r.phi for r in sums} == pytest.approx(
        {k: v for k, v in phi.items() if k[1] != "__base__"}, abs=1e-9)
    mean = {}
    for r in pairs.where("feature <> partner").collect():
        mean.setdefault(r.feature, {}).setdefault(r.partner, []).append(abs(r.phi))
    for r in XP.strongest_partners(pairs).collect():
        means = {p: sum(v) / len(v) for p, v in mean[r.feature].items()}
        assert r.strength == pytest.approx(max(means.values())) == pytest.approx(means[r.partner])


def test_a_deep_forest_is_explained(spark):
    df = frame(spark, 60)
    model = TR.fit_regression(TR.random_forest(4, 30), df, ["a", "b", "c", "d"], "y")
    phi = XP.shap_values(model, df, "k", ["a", "b", "c", "d"], block_leaves=50)
    total = {r.key: r.t for r in phi.groupBy("key").agg(F.sum("phi").alias("t")).collect()}
    pred = {r.k: r.prediction for r in model.transform(df).collect()}
    assert total == pytest.approx(pred, abs=1e-9)


def test_tabled_attributions_equal_those_of_the_leaves():
    import numpy as np

    from phonon.operators import explain as XP
    tree = {"left": [1, 3, 5, -1, -1, -1, -1], "right": [2, 4, 6, -1, -1, -1, -1], "feature": [0, 1, 0, -1, -1, -1, -1],
            "threshold": [0.5, -1.0, 2.0, 0.0, 0.0, 0.0, 0.0], "value": [0.0, 0.0, 0.0, 1.0, -2.0, 4.0, 0.5],
            "cover": [10.0, 6.0, 4.0, 2.0, 4.0, 3.0, 1.0], "weight": 0.7}
    stump = {"left": [-1], "right": [-1], "feature": [-1], "threshold": [0.0], "value": [3.0], "cover": [10.0], "weight": 1.0}
    x = np.array([[0.5, -1.0, 9.0], [0.50001, 0.0, 9.0], [2.0, -5.0, 0.0], [2.5, 1.0, 0.0], [-3.0, -0.9, 1.0]])
    leaves = XP.leaf_boxes(tree) + XP.leaf_boxes(stump)
    tables = [XP.shap_tables(t, 3) for t in (tree, stump)]
    assert np.allclose(XP.tabled_shap(x, tables, []), XP.batch_shap(x, leaves), atol=1e-12)
    assert np.allclose(XP.tabled_shap(x, tables[1:], XP.leaf_boxes(tree)), XP.batch_shap(x, leaves), atol=1e-12)
