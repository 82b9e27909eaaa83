"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from cellgauge.queries import ORACLES, QUERIES
from tests import compare

#: Whole runs, covered by test_calibrate; only their shape is checked here.
RUNS = ["calibrate", "calibrate_hierarchical"]


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_only_whole_runs_lack_a_twin():
    assert sorted(set(QUERIES) - set(ORACLES)) == sorted(RUNS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare.differences(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", RUNS)
def test_whole_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_suppkey", "rho", "reason"]
