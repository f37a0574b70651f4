"""Whitening by the exact characteristic polynomial against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from phonon.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact_polynomial(m):
    """Faddeev-LeVerrier in fractions, constant first."""
    d = len(m)
    eye = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    acc, coefs = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        acc = [[sum(m[i][x] * acc[x][j] for x in range(d)) + coefs[-1] * eye[i][j]
                for j in range(d)] for i in range(d)]
        coefs.append(-sum(m[i][x] * acc[x][i] for i in range(d) for x in range(d)) / k)
    return [int(c) for c in reversed(coefs)]


def scatter_of(rows):
    rows = [[int(v) for v in r] for r in rows]
    n, s = len(rows), [sum(c) for c in zip(*rows, strict=True)]
    return np.array([[n * sum(r[i] * r[j] for r in rows) - s[i] * s[j] for j in range(len(s))]
                     for i in range(len(s))], object)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial_is_exact(spark, d):
    rng = np.random.default_rng(d)
    m = scatter_of(rng.integers(-70, 70, (d + 3, d)))
    assert wh.characteristic(spark, m) == exact_polynomial(m.tolist())
    # needs pivots: zero columns and a block structure
    m[:, 0] = m[0, :] = 0
    assert wh.characteristic(spark, m) == exact_polynomial(m.tolist())


def test_roots_and_null_spaces_with_repeated_and_zero_eigenvalues(spark):
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    for values in ([8, 8, 8, 0], [4, 12, 12, 400], [8, 8, 8, 8], [0, 0, 0, 20], [4, 8, 12, 10**30]):
        m = np.array([[sum(int(q[k, i]) * v * int(q[k, j]) for k, v in enumerate(values))
                       for j in range(4)] for i in range(4)], object)
        want = sorted((4 * v for v in values if v), reverse=True)
        got, axes = wh.components(spark, m, 4)
        assert [round(Fraction(t, 1 << s)) for t, s in got] == want
        assert np.allclose(axes @ axes.T, np.eye(len(want)), atol=1e-14)
        for (t, s), v in zip(got, axes, strict=True):
            lam = Fraction(t, 1 << s)
            rest = [sum(int(m[i, j]) * Fraction(v[j]) for j in range(4)) - lam * Fraction(v[i]) for i in range(4)]
            assert max(abs(float(r / lam)) for r in rest) < 1e-14 or lam * 10**14 < max(want)
    # two eigenvalues that differ in the 25th digit are told apart
    big = 10 ** 24
    m = np.array([[2 * big + 1, 1], [1, 2 * big + 1]], object)
    got, axes = wh.components(spark, m, 2)
    assert [Fraction(t, 1 << s) for t, s in got] == [2 * big + 2, 2 * big]
    assert np.allclose(np.abs(axes), math.sqrt(0.5), atol=1e-15)


def brute(rows, most):
    """Plain numpy and exact sums of (id, vector) rows, all valid."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = ((x * n - s) / n).astype(float)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    order = [k for k in np.argsort(-e) if e[k] > 1e-9 * e.max()][:most]
    return n, dev, centred @ v[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


def held(spark, rows, most=32):
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), most_components=most).collect()
    return sorted(got, key=lambda r: (r.vec_id is None, r.vec_id, r.component))


@pytest.mark.parametrize(("n", "d", "most"), [(300, 8, 32), (300, 40, 32), (5, 8, 32), (60, 6, 3)])
def test_whitening_matches_brute_force(spark, n, d, most):
    rng = np.random.default_rng(n + d)
    mix = rng.normal(size=(d, d))
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=d) @ mix + 3], 0) for i in range(n)]
    count, dev, white, share = brute([r[:2] for r in rows], most)
    got = held(spark, rows, most)
    k = white.shape[1]
    assert k == min(most, d, n - 1) and len(got) == n * k
    w = np.array([r.whitened for r in got]).reshape(n, k)
    assert [r.deviation for r in got[::k]] == dev and {r.n for r in got} == {count}
    assert [r.component for r in got[:k]] == list(range(1, k + 1))
    sign = np.sign((w * white).sum(axis=0))
    assert np.allclose(w * sign, white, atol=1e-6)
    assert np.allclose([r.explained for r in got[:k]], share, rtol=1e-9)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_odd_rows_are_dropped_and_others_unchanged(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist(), 0) for i in range(30)]
    good += [good[0], (None, rng.normal(size=5).tolist(), None)]           # a repeated row, a null id
    odd = [(100, None, 0), (101, [], 0), (102, [1.0, None, 0.0, 0.0, 0.0], 0),
           (103, [float("nan")] * 5, 0), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0),
           (105, [0.5] * 6, 0), (106, [1e30, 0.0, 0.0, 0.0, 0.0], 0), (None, None, None)]
    plain, mixed = held(spark, good), held(spark, good + odd)
    assert plain == mixed and len(plain) == 32 * 5
    assert sum(r.vec_id is None for r in plain) == 5 and sum(r.vec_id == 0 for r in plain) == 10
    frame = spark.createDataFrame(good, SCHEMA).selectExpr("*", "1 AS component", "2 AS i", "3 AS `a.b`")
    assert wh.whiten(frame).count() == 32 * 5


def test_tables_without_spread(spark):
    assert held(spark, []) == []
    assert held(spark, [(1, [0.5, 0.25], 0)] * 4) == []
    assert held(spark, [(1, None, 0)]) == []
    flat = held(spark, [(i, [float(i), 1.0, -float(i)], 0) for i in range(6)])
    assert len(flat) == 6 and {r.component for r in flat} == {1} and flat[0].explained == 1.0


def test_large_entries_stay_exact(spark):
    """Beyond 53 and 64 bits: products of doubles would round, long squares would overflow."""
    rows = [(i, [float(2**44 + 3 * i), float(i * i) * 2.0**30, -float(i % 4)], 0) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(wh.whiten(frame).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 27 and {r.deviation for r in got} == {None}
    w = np.array([r.whitened for r in got]).reshape(9, 3)
    assert np.abs(w.T @ w / 9 - np.eye(3)).max() < 1e-6
    y = [[math.floor(64 * c) for c in v] for _, v, _ in rows]
    n, sums, gram = wh.moments(frame.selectExpr("vec_id AS i", "embedding AS v"), 3)
    assert n == 9 and sums.tolist() == [sum(c) for c in zip(*y, strict=True)]
    assert gram.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
