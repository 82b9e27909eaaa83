"""How many jobs the chains of statistics take: every barrier is one."""

import pytest

import __spark_entry__ as entry
from tests.test_selection import jobs

MOST = {"discrepancy_hier_2ch": 15, "well_summary": 13, "clip_2d": 13}


@pytest.mark.parametrize("name", sorted(MOST))
def test_jobs(spark, name):
    run = lambda: entry.queries()[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    run()
    assert jobs(spark, run) <= MOST[name]
