"""Physical-plan properties that matter at scale (checked on the real plans)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def plan(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(p: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", p))


def test_flagship_prunes_pushes_and_shuffles_twice(spark):
    df = E.queries()["merged_measurements"](spark, SF_SMALL)
    p = plan(spark, df)
    # every source scan reads only the needed columns and pushes its slice filter
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)]" in p
    assert "l_shipdate" not in p and "l_tax" not in p
    # the dedupe limits each key to one row before the shuffle (hot keys shrink map-side)
    assert "WindowGroupLimit" in p and "Partial" in p
    assert shuffles(p) <= 2


def test_best_match_never_pairs_requests_with_all_candidates(spark):
    df = E.queries()["mp_best_match"](spark, SF_SMALL)
    p = plan(spark, df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/part.parquet").count()


def test_composition_shuffles_once(spark):
    p = plan(spark, E.queries()["composition_features"](spark, SF_SMALL))
    assert shuffles(p) == 1


@pytest.mark.parametrize("name,scans", [("summary_statistics", 3), ("regression_metrics", 1),
                                        ("metrics_long", 1), ("nation_attributes", 2)])
def test_scans(spark, name, scans):
    p = plan(spark, E.queries()[name](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet", p)) <= scans, p


FITS = {"model_comparison", "cv_random_search", "tuned_boosting", "feature_set_experiment", "permutation_importance",
        "k_selection", "shap_summary", "cluster_assignment"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.CORPUS_QUERIES) - FITS))
def test_no_cartesian_products(spark, name):
    p = plan(spark, E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_compositions_are_cut_by_their_number(spark, monkeypatch):
    from phonon.sources import fixtures as FX
    monkeypatch.setattr(FX, "PART_ROWS", 100)
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    p = plan(spark, FX.composition_long(spark, SF_SMALL))
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in p
