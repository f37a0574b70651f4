"""Batched k-means against plain Lloyd iterations, and its metrics against brute force."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from phonon.operators import cluster as CL
from phonon.operators import lloyd as LL


def points(seed=0, n=300, d=4, clusters=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, d))[rng.integers(clusters, size=n)] * 6 + rng.normal(size=(n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def plain(x, c, tol=1e-4, most=300):
    for _ in range(most):
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        moved = ((new - c) ** 2).sum(axis=1).max()
        c = new
        if moved <= tol * tol:
            break
    return ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum(), c


def test_every_pair_ends_as_a_fit_of_its_own(spark):
    x = points()
    vectors = frame(spark, x).select("v").cache()
    pairs = [(k, s) for k in (2, 4, 7) for s in range(3)]
    start = LL.seeds(vectors, pairs)
    got, passes = LL.lloyd(vectors, start)
    alone = 0
    for p in pairs:
        cost, centres = plain(x, start[p])
        assert abs(got[p][0] - cost) < 1e-6 * cost and np.allclose(got[p][1], centres, atol=1e-6)
        alone = max(alone, LL.lloyd(vectors, {p: start[p]})[1])
    assert passes == alone                 # as many passes as the slowest pair needs by itself


def test_sweep_takes_the_cheapest_seed_and_its_metrics(spark):
    x = points(1)
    df = frame(spark, x)
    sweep = {(r.k, r.metric): r.value for r in CL.k_sweep(df, "v", [2, 3, 4, 5]).collect()}
    best = LL.best_of_seeds(df, "v", [2, 3, 4, 5])
    for k, (cost, centres) in best.items():
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        labelled = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, near, strict=True)],
                                         "v array<double>, label int")
        m = CL.cluster_metrics(labelled, "label", "v").first()
        assert sweep[k, "Inertia"] == pytest.approx(cost, rel=1e-9) == pytest.approx(m.inertia, rel=1e-6)
        assert sweep[k, "Silhouette"] == pytest.approx(m.silhouette, abs=1e-6)
        assert sweep[k, "Calinski-Harabasz"] == pytest.approx(m.calinski_harabasz, rel=1e-6)
        assert sweep[k, "Davies-Bouldin"] == pytest.approx(m.davies_bouldin, rel=1e-6)
    assert best[2][0] > best[3][0] > best[4][0]


def test_model_labels_saves_and_loads(spark, tmp_path):
    x = points(2, n=120)
    df = frame(spark, x)
    model = CL.fit_kmeans(df, 3, "v")
    want = ((x[:, None] - np.asarray(model.clusterCenters())) ** 2).sum(axis=2).argmin(axis=1)
    got = {r.id: r.cluster_label for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
    path = str(tmp_path / "m")
    PipelineModel([model]).write().overwrite().save(path)
    again = PipelineModel.load(path).transform(df).collect()
    assert {r.id: r.cluster_label for r in again} == got
    with_null = df.unionByName(spark.createDataFrame([(999, None)], "id long, v array<double>"))
    assert model.transform(with_null).where("id = 999").first().cluster_label is None


def test_few_or_equal_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])] * 3, "id long, v array<double>")
    cost, centres = LL.best_of_seeds(one, "v", [3])[3]
    assert cost == 0.0 and centres.tolist() == [[1.0, 2.0]]
    assert LL.best_of_seeds(one.where("id > 0"), "v", [3]) == {}
    assert CL.k_sweep(one.where("id > 0"), "v", [2]).count() == 0


def test_packed_blocks_give_the_same_fits(spark):
    vectors = frame(spark, points(n=5000, d=3)).select("v")
    packed = LL._packed(vectors)
    assert packed.count() < 20                       # blocks, not rows
    start = LL.seeds(vectors, [(k, 1) for k in (2, 5)])
    one, two = (LL.lloyd(v, start)[0] for v in (vectors, packed))
    for p in start:
        assert abs(one[p][0] - two[p][0]) < 1e-9 * one[p][0] and np.allclose(one[p][1], two[p][1], atol=1e-9)
