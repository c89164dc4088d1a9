"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_module

ALL, CHECKED = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_matches_sql(spark, sf, con, name):
    assert compare(ALL[name](spark, sf), con, CHECKED[name]) is None


@pytest.mark.parametrize("name", sorted(set(ALL) - set(CHECKED) - {"fit_clusters", "predict_clusters", "get_centroids"}))
def test_runs(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0


def test_entry(spark):
    row = entry_module.entry(spark).collect()
    assert len(row) == 1 and 0 <= row[0]["accuracy"] <= 1
