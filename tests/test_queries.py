"""Every registered query with a SQL twin equals DuckDB on sf0.001; the rest run."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SLOW = {"model_comparison", "k_selection", "cv_random_search", "tuned_boosting", "feature_set_experiment", "permutation_importance"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - set(E.CORPUS_QUERIES)))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    srows = _rows(df.columns, [tuple(r) for r in df.collect()])
    drows = _rows(dcols, res.fetchall())
    assert len(srows) == len(drows)
    for a, b in zip(srows, drows):
        assert all(_close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - set(E.CORPUS_QUERIES) - SLOW))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["formula", "temperature", "thermal_conductivity", "source"]
    assert df.count() > 0
