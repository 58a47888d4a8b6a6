import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    d = entry.entry(spark)
    assert set(d.columns) == {"phase", "innings", "n_balls", "tension_milli", "momentum_sum", "n_wickets"} and d.count() > 0
