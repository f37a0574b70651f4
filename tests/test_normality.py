"""Kolmogorov-Smirnov against plain Python and tabulated values of the series."""

import math
from statistics import NormalDist, mean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonon.operators import normality as NM


def test_normal_distribution_function(spark):
    z = [-38.0, -30.0, -9.5, -7.1, -7.07, -3.0, -1.0, -1e-9, 0.0, 0.3, 2.5, 7.08, 20.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", NM.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-15)


# Tabulated values of Kolmogorov's distribution: critical points of the limiting distance.
@pytest.mark.parametrize(("x", "p"), [(1.2238, 0.10), (1.3581, 0.05), (1.5174, 0.02), (1.6276, 0.01), (0.8276, 0.50)])
def test_series_at_tabulated_points(spark, x, p):
    n = 10**8                                    # the scaling of the distance is sqrt(n) there
    d = x / (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    row = spark.createDataFrame([(d, n)], "d double, n long").select(
        NM.kolmogorov_tail(F.col("d"), F.col("n")).alias("p")).first()
    assert row.p == pytest.approx(p, abs=2e-4)


def test_distance_matches_plain_python_at_any_partitioning(spark):
    rng = np.random.default_rng(0)
    cols = {"a": rng.normal(3, 2, 700).tolist(), "b": rng.exponential(1, 700).tolist(),
            "c": [float(v) for v in rng.integers(0, 4, 700)], "d": [5.0] * 700}
    cols["a"][0], cols["b"][1] = None, float("nan")
    rows = list(zip(*cols.values(), strict=True))
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = {}
    for f, v in cols.items():
        v = sorted(x for x in v if x is not None and x == x)
        if stdev(v) == 0:
            want[f] = (len(v), None)
            continue
        dist = NormalDist(mean(v), stdev(v))
        want[f] = (len(v), max(max((i + 1) / len(v) - dist.cdf(x), dist.cdf(x) - i / len(v)) for i, x in enumerate(v)))
    for parts in (1, 7):
        got = NM.kolmogorov_smirnov(frame.repartition(parts), list(cols)).collect()
        assert [r.feature for r in got][0] == "a" and [r.feature for r in got][-1] == "d"
        for r in got:
            n, d = want[r.feature]
            assert r.n == n and (r.d is None if d is None else r.d == pytest.approx(d, abs=1e-12))
        assert {r.feature: r.is_normal for r in got} == {"a": True, "b": False, "c": False, "d": None}
    assert NM.kolmogorov_smirnov(frame.where("a > 100"), ["a"]).count() == 0


def test_ks_is_the_same_with_few_buckets_and_ranks_only_some_values(spark):
    rng = np.random.default_rng(4)
    cols = {"even": rng.random(400), "tied": rng.integers(0, 4, 400).astype(float), "bell": rng.normal(size=400)}
    df = spark.createDataFrame([(float(a), float(b), float(c), 1.0) for a, b, c in zip(*cols.values())],
                               "even double, tied double, bell double, flat double").repartition(5)
    for buckets in (1, 8, 1 << 16):
        got = {r["feature"]: r for r in NM.kolmogorov_smirnov(df, [*cols, "flat"], buckets=buckets).collect()}
        for name, v in cols.items():
            u = np.array([NormalDist().cdf(z) for z in (np.sort(v) - v.mean()) / v.std(ddof=1)])
            d = max((np.arange(1, 401) / 400 - u).max(), (u - np.arange(400) / 400).max())
            assert abs(got[name]["d"] - d) < 1e-9 and got[name]["n"] == 400
        assert got["flat"]["n"] == 400 and got["flat"]["d"] is None and got["flat"]["p_value"] is None
