"""Operators on hand tables: dedupe, lookup, quantiles, selection, knee, metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonon.operators import cluster as CL
from phonon.operators import explore as EX
from phonon.operators import lookup as LK
from phonon.operators import merge as M
from phonon.operators import prepare as PR
from phonon.operators.quantiles import exact_quantiles


def test_merge_priority_and_null_rule(spark):
    s1 = spark.createDataFrame([("A", 1.0, "300 K", 1), ("A", None, "10 C", 2)],
                               "formula string, k_expt double, k_condition string, r int")
    s2 = spark.createDataFrame([("A", "300", 5.0, 3), ("A", "283.15", 7.0, 4), ("B", "20", 2.0, 5)],
                               "composition string, temperature string, kappa double, r int")
    out = M.merge_measurements([M.standardize_citrine(s1), M.standardize_ucsb(s2)],
                               tie_break=[F.col("r")])
    got = {(r.formula, r.temperature): (r.thermal_conductivity, r.source) for r in out.collect()}
    # citrine wins 300 K; the citrine NULL row was dropped at load, so ucsb keeps 283.15
    assert got == {("A", 300.0): (1.0, "citrine"), ("A", 283.15): (7.0, "ucsb"),
                   ("B", 20.0): (2.0, "ucsb")}


def test_dedupe_null_hides_worse_source_by_default(spark):
    a = spark.createDataFrame([("A", "300", None, 1)], "composition string, temperature string, kappa double, r int")
    long = spark.createDataFrame([("A", "300", "Thermal conductivity", 9.0, "crystal", 1)],
                                 "formula string, temperature string, property string, value double, phase string, r int")
    srcs = [M.standardize_ucsb(a), M.standardize_nist(long, [F.col("r")])]
    assert M.merge_measurements(srcs, tie_break=[F.col("r")]).count() == 0
    got = M.merge_measurements(srcs, tie_break=[F.col("r")], drop_null_first=True).collect()
    assert [(r.thermal_conductivity, r.source) for r in got] == [(9.0, "nist_thermoml")]


def test_pivot_first_uses_order(spark):
    df = spark.createDataFrame([("A", "1", "density", 2.0, 2), ("A", "1", "density", 1.0, 1),
                                ("A", "1", "thermalconductivity", None, 0)],
                               "f string, t string, property string, value double, o int")
    r = M.pivot_first(df, ["f", "t"], "property", "value", ["density", "thermalconductivity"],
                      [F.col("o")]).first()
    assert r.density == 1.0 and r.thermalconductivity is None


def test_best_match_tiers(spark):
    req = spark.createDataFrame([(1, "X", 5), (2, "X", 7), (3, "X", None), (4, "Y", 1)],
                                "id int, formula string, sg int")
    cand = spark.createDataFrame([("X", 5, 3.0, "a"), ("X", 5, 2.0, "b"), ("X", 6, 1.0, "c"),
                                  ("X", 7, None, "d")],
                                 "formula string, g int, e double, name string")
    out = LK.best_match(req, cand, formula_col="formula", wanted_col="sg", group_col="g",
                        energy_col="e", tie_break=["name"], payload={"pick": "name"},
                        match_col="match")
    got = {r.id: (r.pick, r.match) for r in out.collect()}
    # 1: tier one, lowest energy in group 5; 2: group 7 has only a NULL energy, still tier one;
    # 3: no wanted group -> lowest overall; 4: unknown formula
    assert got == {1: ("b", True), 2: ("d", True), 3: ("c", False), 4: (None, None)}


@pytest.mark.parametrize("n,buckets,final_rows", [(1, 16, 5), (7, 4, 3), (1000, 8, 10), (997, 1024, 1_000_000)])
def test_exact_quantiles_match_numpy(spark, n, buckets, final_rows):
    rnd = random.Random(n)
    vals = [rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 5))]) for _ in range(n)]
    rows = [(i % 3, v) for i, v in enumerate(vals)] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"],
                                           buckets=buckets, final_rows=final_rows,
                                           names=["a", "b", "c", "d", "e"]).collect()}
    for g in range(3):
        xs = [v for i, v in enumerate(vals) if i % 3 == g]
        if not xs:
            continue
        want = np.quantile(xs, [0.0, 0.25, 0.5, 0.9, 1.0])
        have = [got[g].a, got[g].b, got[g].c, got[g].d, got[g].e]
        assert np.allclose(have, want, rtol=1e-12, atol=1e-12)


def test_features_to_drop_rules(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        x = rnd.gauss(0, 1)
        rows.append((x, 2 * x + 1, rnd.gauss(0, 1), 1.0, x if i % 2 else None))
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, m double")
    drop = {r.feature for r in PR.features_to_drop(df, ["a", "b", "c", "k", "m"]).collect()}
    # b copies a (dropped as the later column), k is constant, m is half missing
    assert drop == {"b", "k", "m"}


def test_knee_point_matches_published_rule(spark):
    # a textbook convex decreasing curve: knee at x = 3
    ys = [100, 50, 20, 15, 12, 10, 9, 8]
    df = spark.createDataFrame([("s", i + 1, float(y)) for i, y in enumerate(ys)], "s string, x int, y double")
    assert CL.knee_point(df, ["s"], "x", "y").first().knee == 3


def test_cluster_metrics_against_brute_force(spark):
    rnd = np.random.default_rng(0)
    pts = np.concatenate([rnd.normal(c, 0.5, size=(15, 3)) for c in (0, 3, 6)])
    labels = np.repeat([0, 1, 2], 15)
    df = spark.createDataFrame([(int(l), [float(v) for v in p]) for l, p in zip(labels, pts)],
                               "label int, x array<double>")
    m = CL.cluster_metrics(df, "label", "x").first()
    cents = np.array([pts[labels == k].mean(0) for k in range(3)])
    inertia = sum(((pts[labels == k] - cents[k]) ** 2).sum() for k in range(3))
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    sil = []
    for i in range(len(pts)):
        own = labels == labels[i]
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, labels == k].mean() for k in range(3) if k != labels[i])
        sil.append((b - a) / max(a, b))
    s = [np.sqrt(((pts[labels == k] - cents[k]) ** 2).sum(1)).mean() for k in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(3) if j != i)
                  for i in range(3)])
    g = pts.mean(0)
    ssb = sum(15 * ((cents[k] - g) ** 2).sum() for k in range(3))
    ch = (ssb / 2) / (inertia / (45 - 3))
    assert math.isclose(m.inertia, inertia, rel_tol=1e-9)
    assert math.isclose(m.silhouette, float(np.mean(sil)), rel_tol=1e-9)
    assert math.isclose(m.davies_bouldin, db, rel_tol=1e-9)
    assert math.isclose(m.calinski_harabasz, ch, rel_tol=1e-9)


def test_yeo_johnson_fit_recovers_identity_for_normal(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.gauss(5, 1),) for _ in range(2000)], "x double")
    lam = PR.fit_yeo_johnson(df, ["x"])["x"]
    assert 0.5 < lam < 1.5


def test_hash_split_is_stable_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    train, test = PR.split_train_test(df, "k")
    a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
    assert not (a & b) and len(a | b) == 2000 and 300 < len(b) < 500
    train2, _ = PR.split_train_test(df.repartition(7), "k")
    assert {r.k for r in train2.collect()} == a


def test_anova_pvalue(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in [("a", [1, 2, 3]), ("b", [4, 5, 6])]
                                for v in vs], "g string, v double")
    r = EX.one_way_anova(df, "v", "g").first()
    assert math.isclose(r.f_stat, 13.5, rel_tol=1e-12)
    p = EX.f_test_pvalue(r.f_stat, r.df_between, r.df_within)
    assert math.isclose(p, 0.021311641128756727, rel_tol=1e-6)


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None)], "g int, c string")
    got = {r.g: r.m for r in EX.mode_by_group(df, ["g"], "c", "m").collect()}
    assert got == {1: "a", 2: "Unknown"}


def test_yeo_johnson_lambda_matches_dense_grid(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(2.0, 300), -rng.exponential(0.5, 100)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = PR.fit_yeo_johnson(df, ["x"])["x"]

    def psi(v, l):
        out = np.empty_like(v)
        p, n = v >= 0, v < 0
        out[p] = np.log1p(v[p]) if abs(l) < 1e-12 else ((v[p] + 1) ** l - 1) / l
        out[n] = -np.log1p(-v[n]) if abs(l - 2) < 1e-12 else -(((1 - v[n]) ** (2 - l)) - 1) / (2 - l)
        return out

    grid = np.linspace(-2, 2, 40001)
    llf = [-len(x) / 2 * np.log(psi(x, l).var()) + (l - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
           for l in grid]
    assert abs(lam - grid[int(np.argmax(llf))]) < 2e-3


def test_running_share_across_buckets(spark):
    rng = random.Random(9)
    rows = [("a" if i % 3 else "b", i, float(rng.randint(1, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, o long, v double")
    got = {(r.s, r.o): r.cum_share for r in EX.running_share(df, "s", "o", "v", range_rows=30).collect()}
    for series in ("a", "b"):
        pts = sorted((o, v) for s, o, v in rows if s == series)
        total, acc = sum(v for _, v in pts), 0.0
        for o, v in pts:
            acc += v
            assert math.isclose(got[(series, o)], acc / total, rel_tol=1e-12)


def test_prepare_cluster_analysis_names(spark):
    df = spark.createDataFrame([(1, 10.0, 300.0, "Cubic"), (2, 20.0, 310.0, "Cubic"), (3, 5.0, 400.0, None)],
                               "id int, thermal_conductivity double, temperature double, crystal_system_classified string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, cluster_label int")
    got = {r.cluster_label: r for r in EX.prepare_cluster_analysis(df, labels, "id").collect()}
    assert set(got[0].asDict()) == {"cluster_label", "mean_kappa", "std_kappa", "mean_T", "std_T",
                                    "dominant_crystal_system"}
    assert got[0].mean_kappa == 15.0 and got[0].dominant_crystal_system == "Cubic"
    assert got[1].std_kappa is None and got[1].dominant_crystal_system == "Unknown"


@pytest.mark.parametrize("final_rows", [10, 1_000_000])
def test_exact_quantiles_ungrouped_no_cross_join(spark, final_rows):
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    q = exact_quantiles(df, "v", [0.1, 0.5, 0.99], final_rows=final_rows, buckets=8,
                        names=["a", "b", "c"])
    r = q.first()
    assert np.allclose([r.a, r.b, r.c], np.quantile(vals, [0.1, 0.5, 0.99]), rtol=1e-12)


def test_group_measurements_mean_and_sorted_sources(spark):
    df = spark.createDataFrame([("A", 300.0, 1.0, "ucsb"), ("A", 300.0, 3.0, "citrine"),
                                ("A", 300.0, 2.0, "ucsb"), ("B", 10.0, 5.0, "nist_thermoml")],
                               "formula string, temperature double, thermal_conductivity double, source string")
    got = {(r.formula, r.temperature): (r.thermal_conductivity, r.source)
           for r in M.group_measurements(df).collect()}
    assert got == {("A", 300.0): (2.0, "citrine,ucsb"), ("B", 10.0): (5.0, "nist_thermoml")}


def test_impute_and_clean_fills_mean_temperature(spark):
    df = spark.createDataFrame([("A", "100 K", 1.0), ("B", None, 2.0), ("C", "300 K", 3.0),
                                (None, "50 K", 4.0), ("D", "70 K", None)],
                               "formula string, temperature string, thermal_conductivity double")
    got = {r.formula: r.temperature for r in M.impute_and_clean(df).collect()}
    # mean over every parsed temperature (100, 300, 50, 70) fills B; rows without formula/target go
    assert got == {"A": 100.0, "B": 130.0, "C": 300.0}


def test_validate_input_counts_and_lists_offenders(spark):
    from phonon.operators import shape as SH
    df = spark.createDataFrame([(1, "SiO2", "152"), (2, "GaN", "231"), (3, "Si", "abc"), (4, "C", None)],
                               "id int, formula string, space_group string")
    summary, offenders = SH.validate_input(df, ["formula"], "space_group", key="id")
    r = summary.first()
    assert (r.n_rows, r.n_invalid) == (4, 3)
    assert [o.id for o in offenders.collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        SH.validate_input(df, ["formula", "temperature"])


@pytest.mark.parametrize("best", [-5.0, 5.0])
def test_yeo_johnson_lambda_is_not_bounded(spark, best):
    """Values whose transform at ``best`` is normal: the fit finds that lambda."""
    rng = np.random.default_rng(7)
    # psi at lambda is ((x + 1) ** lambda - 1) / lambda for x >= 0; inverted on a safe range
    z = np.clip(rng.normal(0.1 if best < 0 else 40.0, 0.02 if best < 0 else 8.0, 4000),
                0.02 if best < 0 else 5.0, 0.19 if best < 0 else 90.0)
    x = (z * best + 1) ** (1 / best) - 1
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = PR.fit_yeo_johnson(df, ["x"])["x"]
    dense = np.arange(-9, 9, 0.01)
    score = [-len(x) / 2 * np.log(np.var(((x + 1) ** d - 1) / d if abs(d) > 1e-9 else np.log1p(x)))
             + (d - 1) * np.log1p(x).sum() for d in dense]
    assert abs(lam - dense[int(np.argmax(score))]) < 0.02 and abs(lam) > 3


def test_correlations_match_numpy_at_full_width(spark):
    rng = np.random.default_rng(2)
    d = 60
    x = rng.normal(size=(500, d)) * np.logspace(-3, 6, d) + 1e4
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = 7.5
    x[rng.random((500, d)) < 0.05] = np.nan
    cols = [f"f{k}" for k in range(d)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in EX.correlation_pairs(df, cols).collect()}
    assert len(got) == d * (d - 1) // 2
    for i in range(d):
        for j in range(i + 1, d):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 2 in (i, j):
                assert got[cols[i], cols[j]] is None
                continue
            assert math.isclose(got[cols[i], cols[j]], np.corrcoef(x[ok, i], x[ok, j])[0, 1],
                                rel_tol=1e-7, abs_tol=1e-9)
    assert "f1" in {r.feature for r in PR.features_to_drop(df, cols).collect()}


def test_nan_becomes_null_at_every_source(spark, tmp_path):
    from phonon.operators import shape as SH
    from phonon.sources import tables as TB
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, v double")
    df.write.parquet(f"{tmp_path}/p")
    df.write.option("header", True).csv(f"{tmp_path}/c")
    for got in (TB.read_parquet(spark, f"{tmp_path}/p", "k int, v double"),
                TB.read_csv(spark, f"{tmp_path}/c", "k int, v double"),
                TB.read_or_compute(spark, f"{tmp_path}/none", None, f"{tmp_path}/c", "k int, v double")):
        assert {r.k: r.v for r in got.collect()} == {1: None, 2: 2.0}
    assert TB.read_parquet(spark, f"{tmp_path}/missing", "k int").count() == 0
    text = spark.createDataFrame([("NaN",), (" 1.5 ",), ("x",)], "t string")
    assert [r[0] for r in text.select(SH.to_double("t")).collect()] == [None, 1.5, None]


@pytest.mark.parametrize("a,b,x", [(0.5, 3.0, 0.2), (12.5, 1.0, 0.9), (40.0, 60.0, 0.4), (2.0, 2.0, 0.5)])
def test_beta_ratio_matches_the_integral(a, b, x):
    t = np.linspace(0, 1, 2_000_001)[1:-1]
    f = t ** (a - 1) * (1 - t) ** (b - 1)
    assert math.isclose(EX.beta_ratio(a, b, x), f[t <= x].sum() / f.sum(), rel_tol=3e-3)
    assert math.isclose(EX.beta_ratio(a, b, x) + EX.beta_ratio(b, a, 1 - x), 1.0, rel_tol=1e-12)


def test_density_over_atoms(spark):
    from phonon.plans import featurize as FZ
    atoms = spark.createDataFrame([(1, "Na"), (1, "Cl"), (2, "Si"), (2, "Qq")], "id int, element string")
    lattice = [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 3.0]]
    lattices = spark.createDataFrame([(1, lattice), (2, lattice), (3, lattice)],
                                     "id int, lattice array<array<double>>")
    mass = spark.createDataFrame([("Na", 22.99), ("Cl", 35.45), ("Si", 28.09)], "element string, mass double")
    got = dict(FZ.structure_densities(atoms, lattices, "id", mass).collect())
    assert math.isclose(got[1], 58.44 / 48 * 1.66054, rel_tol=1e-12) and got[2] is None and got[3] is None


def test_pivot_fails_on_a_value_without_a_column(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "z", 2.0)], "k int, p string, v double")
    with pytest.raises(Exception, match="without a column: z"):
        M.pivot_first(df, ["k"], "p", "v", ["a", "b"], [F.col("v")]).collect()


def test_quantiles_of_widely_spread_values(spark):
    x = [10.0 ** (k / 20) for k in range(-6000, 6000, 10)] + [float(k) for k in range(500)]
    df = spark.createDataFrame([(v, 1) for v in x], "v double, g int")
    for g in ([], ["g"]):
        r = exact_quantiles(df, "v", [0.1, 0.5, 0.9], g, buckets=64, final_rows=50, names=["a", "b", "c"]).first()
        assert np.allclose([r.a, r.b, r.c], np.quantile(x, [0.1, 0.5, 0.9]), rtol=1e-12)
