"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference, duck

from lorebase.plans.oracles import ORACLES
from lorebase.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in ORACLES:
        assert df.count() > 0
        return
    assert difference(df, con, ORACLES[name]) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
