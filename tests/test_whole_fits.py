"""Registered queries fit on all training rows: tables of more rows than any former bound."""

import pytest

from phonon.operators import train as TR
from phonon.operators.explain import tree_tables
from phonon.plans import catalog as C
from phonon.sources.tables import TABLE_SCHEMAS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rows"))
    lines = [(i // 4, i % 40, i % 9, i % 4, float(i * 7 % 50 + 1), float(900 + i * 37 % 5000), i % 11 / 100, i % 9 / 100,
              "N", "O", None) for i in range(1800)]
    parts = [(i, "p", "b", "t", i % 25 + 1, 900.0 + i) for i in range(40)]
    spark.createDataFrame(lines, TABLE_SCHEMAS["lineitem"]).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(parts, TABLE_SCHEMAS["part"]).write.parquet(f"{at}/part.parquet")
    return at


def training_rows(spark, folder):
    n = C._split(spark, folder)[0].count()
    assert n > C.FIT_ROWS
    return n


def test_permutation_importance_fits_on_all_rows(spark, folder, monkeypatch):
    make, whole, held = TR.gradient_boosting, TR.permutation_importance, []
    monkeypatch.setattr(TR, "gradient_boosting", lambda: make(2))
    monkeypatch.setattr(TR, "permutation_importance", lambda model, *a: held.append(model) or whole(model, *a, repeats=1))
    assert C.QUERIES["permutation_importance"](spark, folder).count() == 5
    assert tree_tables(spark, held[0].stages[-1])[0][0]["cover"][0] == training_rows(spark, folder)


def test_shap_summary_fits_on_all_rows(spark, folder, monkeypatch):
    make, whole, held = TR.gradient_boosting, C.XP.shap_values, []
    monkeypatch.setattr(TR, "gradient_boosting", lambda: make(2))
    monkeypatch.setattr(C.XP, "shap_values", lambda model, *a: held.append(model) or whole(model, *a))
    assert C.QUERIES["shap_summary"](spark, folder).count() == 5
    assert tree_tables(spark, held[0].stages[-1])[0][0]["cover"][0] == training_rows(spark, folder)


def test_feature_set_experiment_fits_on_all_rows(spark, folder, monkeypatch):
    make, score, held = TR.boosted_trees, TR.GBTRegressionModel.transform, {}
    monkeypatch.setattr(TR, "boosted_trees", lambda: make(2))
    monkeypatch.setattr(TR.GBTRegressionModel, "transform", lambda m, *a: held.setdefault(m.uid, m) and score(m, *a))
    assert {r["model"] for r in C.QUERIES["feature_set_experiment"](spark, folder).collect()} == {
        "all", "selected", "selected_clusters"}
    assert held and all(tree_tables(spark, m)[0][0]["cover"][0] == training_rows(spark, folder) for m in held.values())


def test_model_comparison_gives_all_rows_to_every_trainer(spark, folder, monkeypatch):
    held = []

    class Probe(TR.LinearRegression):
        def fit(self, rows):
            held.append(rows.count())
            return super().fit(rows)

    assert set(TR.default_trainers()) == {"random_forest", "gradient_boosting", "boosted_trees", "kernel_regression",
                                          "huber_linear"}
    monkeypatch.setattr(TR, "default_trainers", lambda: {"probe": Probe})
    assert C.QUERIES["model_comparison"](spark, folder).count() == 2
    assert held == [training_rows(spark, folder)] * 2
