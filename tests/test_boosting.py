"""Histogram boosting against a plain recursive version, and the search over all rows of a fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonon.operators import boosting as B
from phonon.operators.prepare import hash_bucket


def brute_tree(x, g, s, depth=None):
    """{path: value} of a tree grown by enumerating every threshold."""
    depth = s.depth if depth is None else depth

    def t(v):
        return np.sign(v) * max(abs(v) - s.l1, 0.0)

    def score(rows):
        return t(g[rows].sum()) ** 2 / (len(rows) + s.l2)

    def build(rows, left):
        best = (max(s.least_gain, 1e-6), None, None)
        if left:
            for f in range(x.shape[1]):
                for cut in range(B.BINS - 1):
                    low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if len(low) < s.least_weight or len(high) < s.least_weight:
                        continue
                    gain = score(low) + score(high) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        if best[1] is None:
            return -t(g[rows].sum()) / (len(rows) + s.l2) * s.step
        _, f, cut = best
        return (f, cut, build(rows[x[rows, f] <= cut], left - 1), build(rows[x[rows, f] > cut], left - 1))

    return build(np.arange(len(x)), depth)


def value(tree, row):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def brute_model(x, y, s):
    margin = np.full(len(y), y.mean())
    trees = []
    for _ in range(s.rounds):
        tree = brute_tree(x, margin - y, s)
        margin = margin + np.array([value(tree, r) for r in x])
        trees.append(tree)
    return margin


def data(seed, n=120, width=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, B.BINS, (n, width)).astype(np.uint8)
    y = np.sin(x[:, 0] / 5) + (x[:, 1] > 10) + rng.normal(size=n) / 10
    return x, y


@pytest.mark.parametrize("s", [B.Settings(rounds=5, depth=3), B.Settings(rounds=4, depth=4, l1=0.4, l2=2.0, step=0.1),
                               B.Settings(rounds=4, depth=6, least_gain=0.3), B.Settings(rounds=3, depth=3, least_weight=10)])
def test_model_matches_brute_force(s):
    x, y = data(1)
    base, trees = B.boost(x, y, s)
    assert np.allclose(B.predict(base, trees, x), brute_model(x, y, s), atol=1e-9)


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in rng.normal(size=3))
        rows.append((i, a, b if i % 7 else None, c, float(np.sin(2 * a) + (c > 0.5) + rng.normal() / 20)))
    rows.append((n, 0.0, float("nan"), 0.0, None))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def test_shared_passes_equal_one_block_and_all_models_at_once(spark):
    df = frame(spark).repartition(3)
    binning = B.fit_binning(df, ["a", "b", "c"])
    blocks = B.binned(df, binning, "y", "id", 4, block_rows=37).cache()
    got = blocks.collect()
    models = [(B.Settings(rounds=4, depth=3), None), (B.Settings(rounds=6, depth=5, l1=0.1, l2=2.0), 2)]
    shared = B.fit_shared(blocks, 3, models)
    for (s, out), (base, trees) in zip(models, shared, strict=True):
        kept = [r for r in got if r["fold"] != out]
        x = np.concatenate([B._matrix(r["x"], 3) for r in kept])
        y = np.concatenate([np.frombuffer(r["y"], float) for r in kept])
        want_base, want = B.boost(x, y, s)
        assert abs(base - want_base) < 1e-12 and len(trees) == s.rounds
        assert np.allclose(B.predict(base, trees, x), B.predict(want_base, want, x), atol=1e-9)
    assert sum(len(r["y"]) // 8 for r in got) == 400 and max(len(r["y"]) // 8 for r in got) <= 37


def test_fitted_model_learns_and_transforms(spark):
    df = frame(spark, 800)
    model = B.fit_boosted(df, ["a", "b", "c"], "y", "id", B.Settings(rounds=25, depth=4))
    out = model.transform(frame(spark, 400, seed=1)).where("y IS NOT NULL")
    r = out.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse"), F.var_pop("y").alias("v")).first()
    assert r["mse"] < 0.15 * r["v"]
    # a missing feature counts as the training median
    a, b = (model.transform(spark.createDataFrame([(0.3, v, 0.1)], "a double, b double, c double")).first()["prediction"]
            for v in (None, model.binning.medians[1]))
    assert a == b


def test_search_judges_all_rows_of_every_fold(spark):
    df = frame(spark, 600).repartition(5)
    feats = ["a", "b", "c"]
    best, table = B.search(df, feats, "y", "id", n_draws=3, folds=4, rounds=(5, 12), fit_rows=10_000)
    got = {r["draw"]: r for r in table.collect()}
    assert set(got) == {0, 1, 2} and all(r["n"] == 600 for r in got.values())
    binning = B.fit_binning(df, feats)
    blocks = sorted(B.binned(df, binning, "y", "id", 4).collect(), key=lambda r: (r["fold"], r["block"]))
    folds = {f: (np.concatenate([B._matrix(r["x"], 3) for r in blocks if r["fold"] == f]),
                 np.concatenate([np.frombuffer(r["y"], float) for r in blocks if r["fold"] == f])) for f in range(4)}
    assert {r.id for r in df.where(hash_bucket("id", 4) == 1).collect()} and len(folds) == 4
    for k, s in enumerate(B.draws(3, rounds=(5, 12))):
        mse = []
        for f in range(4):
            x = np.concatenate([folds[j][0] for j in range(4) if j != f])
            y = np.concatenate([folds[j][1] for j in range(4) if j != f])
            base, trees = B.boost(x, y, s, f)
            mse.append(((B.predict(base, trees, folds[f][0]) - folds[f][1]) ** 2).mean())
        # shares of rows depend on the order of the sample's blocks: a wide band for them, exact without
        assert abs(got[k]["cv_mse"] - np.mean(mse)) < 0.1 * np.mean(mse)
    assert best == B.draws(3, rounds=(5, 12))[min(got, key=lambda k: (got[k]["cv_mse"], k))]
    # a bound on the fitted rows changes the models, not the rows they are judged on
    _, small = B.search(df, feats, "y", "id", n_draws=2, folds=4, rounds=(5, 6), fit_rows=100)
    assert {r["n"] for r in small.collect()} == {600}


def test_empty_tables_and_constant_labels(spark):
    none = frame(spark, 5).where("id < 0")
    best, table = B.search(none, ["a"], "y", "id", n_draws=2, folds=2, rounds=(2, 2))
    assert table.count() == 0 and best == B.Settings()
    flat = frame(spark, 50).withColumn("y", F.lit(2.0))
    model = B.fit_boosted(flat, ["a"], "y", "id", B.Settings(rounds=2))
    assert {r.prediction for r in model.transform(flat).collect()} == {2.0}


def test_grid_predicts_as_the_trees_do():
    x, y = data(3, 300, 3)
    base, trees = B.boost(x, y, B.Settings(rounds=20, depth=6))
    rows = np.unique(np.random.default_rng(5).integers(0, B.BINS, (4000, 3)).astype(np.uint8), axis=0)
    at = B.judge(base, trees, [B.BINS] * 3)
    got = np.concatenate([at(rows[a:a + 700]) for a in range(0, len(rows), 700)])     # a slab goes over several batches
    assert np.allclose(got, B.predict(base, trees, rows), atol=1e-9)
    one = np.arange(B.BINS, dtype=np.uint8)[:, None]
    base, trees = B.boost(x[:, :1].copy(), y, B.Settings(rounds=5, depth=3))
    assert np.allclose(B.judge(base, trees, [B.BINS])(one), B.predict(base, trees, one), atol=1e-9)


def test_cells_stand_for_all_their_rows(spark):
    df = frame(spark, 300).withColumn("a", F.round("a")).withColumn("c", F.round("c")).drop("b")
    many = df.unionByName(df).unionByName(df)
    binning = B.fit_binning(many, ["a", "c"])
    held = B.cells(many, binning, "y", "id", 1)
    assert held.agg(F.sum("n")).first()[0] == 900 and held.count() < 200
    s = B.Settings(rounds=4, depth=4)
    (base, got), = B.fit_shared(B.cell_blocks(held), 2, [(s, None)])
    blocks = B.binned(many, binning, "y", "id", 1).collect()
    x, y = np.concatenate([B._matrix(r["x"], 2) for r in blocks]), np.concatenate([np.frombuffer(r["y"]) for r in blocks])
    want_base, want = B.boost(x, y, s)
    assert np.allclose(B.predict(base, got, x), B.predict(want_base, want, x), atol=1e-9)


def test_search_fits_on_all_rows_of_the_other_folds(spark, monkeypatch):
    # one model, no rows drawn: the search equals fits on all rows, also beyond the former bound of 20000
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 25, 24_000), rng.integers(0, 20, 24_000)
    y = np.sin(a / 4) + b / 20 + rng.normal(size=24_000)
    df = spark.createDataFrame([(i, float(p), float(q), float(r)) for i, (p, q, r) in enumerate(zip(a, b, y, strict=True))],
                               "id long, a double, b double, y double").repartition(4)
    s = B.Settings(rounds=3, depth=4)
    monkeypatch.setattr(B, "draws", lambda *_: [s])
    _, table = B.search(df, ["a", "b"], "y", "id", n_draws=1, folds=3)
    blocks = B.binned(df, B.fit_binning(df, ["a", "b"]), "y", "id", 3).collect()
    mse = []
    for f in range(3):
        x, y, seen, want = (np.concatenate([v for r in blocks if (r["fold"] == f) == own for v in [
            B._matrix(r["x"], 2) if binned else np.frombuffer(r["y"])]]) for own, binned in (
                (False, True), (False, False), (True, True), (True, False)))
        mse.append(((B.predict(*B.boost(x, y, s, f), seen) - want) ** 2).mean())
    got = table.first()
    assert got["n"] == 24_000 and abs(got["cv_mse"] - np.mean(mse)) < 1e-9


def test_parts_of_the_rows_give_the_same_model(monkeypatch):
    x, y = data(7, 900, 3)
    s = B.Settings(rounds=4, depth=5)
    base, trees = B.boost(x, y, s)
    monkeypatch.setattr(B, "PART_ROWS", 128)
    monkeypatch.setattr(B, "IN_MEMORY", 64)                   # arrays in files
    again, others = B.boost(x, y, s)
    assert abs(base - again) < 1e-12 and np.allclose(B.predict(base, trees, x), B.predict(again, others, x), atol=1e-9)
