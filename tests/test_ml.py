"""Models, normality, streaming scoring: invariants (rows-only operators)."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from phonon.operators import normality as NM
from phonon.operators import prepare as PR
from phonon.operators import train as TR
from phonon.sources import fixtures as FX
from phonon.streaming import score as ST


def shapiro(spark, values, parts=3):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(parts)
    return NM.shapiro_by_feature(df, ["x"]).first()


def test_shapiro_known_small_case(spark):
    r = shapiro(spark, [1.0, 2.0, 4.0])
    assert math.isclose(r.w, 0.9642857, rel_tol=1e-6) and math.isclose(r.p_value, 0.6368, abs_tol=1e-3)


def test_shapiro_published_example(spark):
    """The eleven weights of the test's original paper: W = 0.79."""
    r = shapiro(spark, [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert math.isclose(r.w, 0.79, abs_tol=0.003) and r.p_value < 0.01 and not r.is_normal


def test_shapiro_separates_normal_from_exponential(spark):
    rng = np.random.default_rng(42)
    assert shapiro(spark, rng.normal(size=1000)).p_value > 0.01
    assert shapiro(spark, rng.exponential(size=1000)).p_value < 1e-6


def test_shapiro_takes_all_rows_and_ignores_the_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), None if i % 3 else 1.0, float(i % 4))
            for i, (a, b) in enumerate(zip(rng.normal(size=7000), rng.exponential(size=7000)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [{r.feature: r for r in NM.shapiro_by_feature(df.repartition(n), list("abcd")).collect()}
           for n in (1, 7)]
    for f in "abd":
        assert got[0][f].n == 7000 and got[0][f].p_value is None
        assert math.isclose(got[0][f].w, got[1][f].w, rel_tol=1e-9)
    # with this many values W is near the squared correlation with the normal scores
    for f, x in (("a", [r[0] for r in rows]), ("d", [r[3] for r in rows])):
        m = np.asarray([NM._N.inv_cdf((i - 0.375) / 7000.25) for i in range(1, 7001)])
        assert math.isclose(got[0][f].w, np.corrcoef(m, np.sort(x))[0, 1] ** 2, abs_tol=2e-3)
    assert got[0]["c"].n == 2334 and math.isnan(got[0]["c"].w)


def test_normal_quantile(spark):
    ps = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.7, 0.98, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", NM.normal_quantile(F.col("p")).alias("z")).collect():
        assert math.isclose(r.z, NM._N.inv_cdf(r.p), rel_tol=1e-8, abs_tol=1e-8)


def test_model_roundtrip_and_stream_scoring(spark):
    t = FX.modelling_table(spark, SF_SMALL)
    train, test = PR.split_train_test(t, "row_key")
    model, metrics, _ = TR.train_and_evaluate(TR.random_forest(10, 8), train, test,
                                              FX.MODEL_FEATURES, "l_extendedprice")
    r2 = {r.scale: r.r2 for r in metrics.collect()}
    # the synthetic target is unrelated to the features: only check the table
    assert set(r2) == {"log", "original"} and all(math.isfinite(v) and v <= 1 for v in r2.values())
    base = tempfile.mkdtemp(prefix="phonon-stream-")
    path = os.path.join(base, "model")
    TR.save_model(model, path)
    batch = TR.score_batch(TR.load_model(path), test, FX.MODEL_FEATURES, raw_target=False)
    src = os.path.join(base, "in")
    test.write.parquet(src)
    ST.score_directory(spark, path, src, test.schema, FX.MODEL_FEATURES,
                       os.path.join(base, "out"), os.path.join(base, "ckpt"))
    streamed = spark.read.parquet(os.path.join(base, "out"))
    col = "predicted_thermal_conductivity_W_mK"
    a = {r.row_key: r[col] for r in batch.collect()}
    b = {r.row_key: r[col] for r in streamed.collect()}
    assert a == b and len(a) > 100


def test_permutation_importance_finds_signal(spark):
    rows = [(str(i), float(i % 50), float((i * 7) % 13), float(i % 50) * 100.0 + 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_key string, x double, noise double, y double")
    model, _, _ = TR.train_and_evaluate(TR.gradient_boosting(10), df, df.limit(0), ["x", "noise"], "y")
    imp = {r.feature: r.importance for r in TR.permutation_importance(
        model, df.repartition(5), ["x", "noise"], "y", repeats=3).collect()}
    assert imp["x"] > 0.5 and abs(imp["noise"]) < 0.05


def test_permute_column_is_a_permutation(spark):
    df = spark.range(5000).repartition(7).select(F.col("id").cast("string").alias("k"), (F.col("id") * 3).alias("v"))
    p = TR.permute_column(df, "v", seed=7)
    assert p.columns == df.columns and sorted(r.v for r in p.collect()) == sorted(r.v for r in df.collect())
    assert p.join(df.withColumnRenamed("v", "v0"), "k").where("v <> v0").count() > 4000
    assert TR.permute_column(df.where("v < 0"), "v", seed=7).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 101, 4095, 4099, 20_001])
def test_feistel_is_a_bijection_at_odd_sizes(spark, n):
    both = spark.range(n).select(*[TR.feistel(F.col("id"), n, F.lit(seed)).alias(f"s{seed}") for seed in (1, 2)]).collect()
    assert sorted(r.s1 for r in both) == sorted(r.s2 for r in both) == list(range(n))
    if n > 50:
        assert [r.s1 for r in both] != [r.s2 for r in both]
        # far from the identity, and no trend between number and place
        mean = (n - 1) / 2
        cov = sum((i - mean) * (r.s1 - mean) for i, r in enumerate(both)) / sum((i - mean) ** 2 for i in range(n))
        assert abs(cov) < 4 / n ** 0.5


def test_numbering_is_dense_wherever_the_rows_lie(spark):
    rows, n = TR.numbered(spark.range(1000).repartition(13), "i")
    assert n == 1000 and sorted(r.i for r in rows.collect()) == list(range(1000))


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_shap_adds_up_to_prediction(spark, kind):
    from phonon.operators import explain as XP
    rng = np.random.default_rng(5)
    rows = [(str(i), float(a), float(b), float(c), float(3 * a + b * b + rng.normal()))
            for i, (a, b, c) in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double")
    reg = TR.gradient_boosting(8, 3) if kind == "gbt" else TR.random_forest(6, 4)
    model = TR.regression_pipeline(["a", "b", "c"], reg).fit(df.withColumn("label", F.col("y")))
    phi = XP.shap_values(model, df, "k", ["a", "b", "c"])
    sums = phi.groupBy("key").agg(F.sum("phi").alias("s"))
    pred = model.transform(df).select(F.col("k").alias("key"), "prediction")
    diff = sums.join(pred, "key").select(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0]
    assert diff < 1e-9
    top = XP.mean_abs_shap(phi).first().feature
    assert top in ("a", "b")


def test_cli_train_then_score(spark):
    from phonon.plans import catalog as C
    from phonon.plans.cli import main
    base = tempfile.mkdtemp(prefix="phonon-cli-")
    # a target that depends on the composition
    feats = C.q_featurized_table(spark, SF_SMALL).where("MagpieData_mean_size IS NOT NULL").withColumn(
        "temperature", F.col("MagpieData_mean_size") * 10 + F.col("MagpieData_range_price") / 1e4)
    feats.write.parquet(os.path.join(base, "features"))
    FX.symbol_properties(spark, SF_SMALL).write.parquet(os.path.join(base, "elements"))
    main(["train", "--features-table", os.path.join(base, "features"), "--target", "temperature",
          "--key", "p_partkey", "--model", os.path.join(base, "model"), "--iterations", "20",
          "--element-table", os.path.join(base, "elements"), "--stat-props", "size,price",
          "--orbital-cols", "s=s_valence,p=p_valence,d=d_valence,f=f_valence"])
    rows = spark.createDataFrame([("CdS", 300.0, 152), ("ZnFe2O4", 300.0, 152)],
                                 "formula string, temperature double, space_group int")
    rows.coalesce(1).write.option("header", True).csv(os.path.join(base, "in"))
    main(["score", "--model", os.path.join(base, "model"), "--input", os.path.join(base, "in"),
          "--output", os.path.join(base, "out"),
          "--schema", "formula string, temperature double, space_group int"])
    out = spark.read.option("header", True).csv(os.path.join(base, "out"))
    assert out.count() == 2 and "predicted_thermal_conductivity_W_mK" in out.columns
    got = {r.formula: float(r["predicted_thermal_conductivity_W_mK"]) for r in out.collect()}
    assert got["CdS"] != got["ZnFe2O4"] and all(math.isfinite(v) for v in got.values())


def test_report_tables_written(spark):
    from phonon.operators import explain as XP
    t = FX.modelling_table(spark, SF_SMALL)
    train, test = PR.split_train_test(t, "row_key")
    model, _, pred = TR.train_and_evaluate(TR.gradient_boosting(3), train, test, FX.MODEL_FEATURES,
                                           "l_extendedprice")
    prefix = tempfile.mkdtemp(prefix="phonon-report-")
    XP.write_report(model, pred, test, "row_key", FX.MODEL_FEATURES, prefix)
    for part in ["parity", "residuals", "shap_values", "shap_summary", "importance"]:
        assert spark.read.parquet(os.path.join(prefix, part)).count() > 0
    assert spark.read.parquet(os.path.join(prefix, "residuals")).agg(F.sum("count")).first()[0] == test.count()


def test_feature_table_build_and_training_run(spark):
    from phonon.plans import catalog as C
    from phonon.plans import featurize as FZ
    from phonon.operators import merge as M
    s1, s2, s3 = FX.measurement_sources(spark, SF_SMALL)
    sources = [M.standardize_citrine(s1), M.standardize_ucsb(s2),
               M.standardize_nist(s3, [F.col(c) for c in FX.TIE_COLS])]
    props = FX.symbol_properties(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="phonon-ft-"), "features")
    kw = dict(element_props=props, stat_props=FX.ELEMENT_STAT_PROPS, orbital_cols=FX.ELEMENT_ORBITALS)
    tie = [F.col(c).asc_nulls_last() for c in FX.TIE_COLS] + \
        [F.col("thermal_conductivity").asc_nulls_last()]
    table = FZ.build_feature_table(spark, path, sources, tie, kw)
    n = table.count()
    assert n == C.merged_measurements_df(spark, SF_SMALL).count()
    assert os.path.exists(os.path.join(path, "_SUCCESS"))
    # a second call reads the stored table instead of recomputing
    again = FZ.build_feature_table(spark, path, [], [], {})
    assert again.count() == n and "MagpieData_mean_size" in again.columns
    model, metrics, cols = FZ.run_pipeline(again, "thermal_conductivity", "formula",
                                           trainer=TR.boosted_trees(3))
    assert "MagpieData_mean_size" in cols and metrics.count() == 2


def nulls(spark):
    rows = [(f"k{i}", float(i % 10), None if i % 7 == 0 else float(i % 10), 10.0 * (i % 10) + 1.0)
            for i in range(600)]
    return spark.createDataFrame(rows, "k string, a double, x double, y double")


def test_a_missing_feature_scores_like_the_training_median(spark):
    df = nulls(spark)
    model, _, _ = TR.train_and_evaluate(TR.gradient_boosting(20), df, df.limit(0), ["x"], "y")
    median = model.stages[0].surrogateDF.first()["x"]
    rows = spark.createDataFrame([("null", None), ("median", float(median)), ("nan", float("nan")),
                                  ("max", 9.0)], "k string, x double")
    got = {r.k: r[-1] for r in TR.score_batch(model, rows, ["x"]).collect()}
    assert got["null"] == got["median"] == got["nan"] != got["max"]
    out = TR.score_batch(model, rows, ["x"])
    assert out.columns[:2] == ["k", "x"] and out.where("k = 'null' AND x IS NULL").count() == 1


def test_imputation_is_fitted_on_training_rows_only(spark):
    from phonon.plans import featurize as FZ
    df = nulls(spark).withColumn("x", F.when(PR.hash_bucket("k") == 0, 1e9).otherwise(F.col("x")))
    model, _, cols = FZ.run_pipeline(df, "y", "k", trainer=TR.gradient_boosting(2))
    assert model.stages[0].surrogateDF.first()["x"] < 10


def test_scoring_rejects_space_groups_that_are_no_numbers(spark):
    from phonon.plans import featurize as FZ
    base = tempfile.mkdtemp(prefix="phonon-bad-")
    for k, bad in enumerate(["abc", "", "231"]):
        path = os.path.join(base, f"in{k}")
        spark.createDataFrame([("SiO2", "152"), ("GaN", bad)], "formula string, space_group string"
                              ).coalesce(1).write.option("header", True).csv(path)
        with pytest.raises(ValueError, match="1 rows have an invalid space group"):
            FZ.score_csv(spark, "unused", path, "formula string, space_group int", [], "unused",
                         required=["formula"])


def test_cluster_pipeline_takes_nulls(spark):
    from phonon.operators import cluster as CL
    df = nulls(spark)
    model = CL.fit_cluster_pipeline(df, ["a", "x"], k=2, restarts=2)
    out = CL.add_cluster_label(df.select("k", "a", "x"), model, ["a", "x"])
    assert out.columns == ["k", "a", "x", "cluster_label"] and out.where("cluster_label IS NULL").count() == 0


def test_code_reaches_the_workers_from_another_folder():
    """The functions that run in Python workers do so when the package is not on their path."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from phonon.session import get_spark\n"
            "from phonon.operators import explore as EX\n"
            "s = get_spark(master='local[2]', shuffle_partitions=2)\n"
            "df = s.range(50).selectExpr('double(id) AS a', 'double(id * id) AS b')\n"
            "r = EX.correlation_pairs(df, ['a', 'b']).first()\n"
            "assert 0.9 < r['corr'] < 1, r\n" % root)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="phonon-cwd-"),
                          env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_bounded_rows_of_a_fit_are_stored_in_few_parts(spark):
    df = spark.range(4000).select("id", *[(F.col("id") % m).cast("double").alias(f"x{m}") for m in (3, 7)],
                                  F.col("id").cast("double").alias("y")).repartition(16)
    fitted, rows = TR.prepared_rows(df, ["x3", "x7"], "y", key="id", fit_rows=200)
    assert rows.rdd.getNumPartitions() == 1 and 100 < rows.count() < 300 and len(fitted) == 3
