"""Every query against its SQL, at the smallest scale."""

import pytest
from conftest import same_rows

from inkflow.plans import queries as core


@pytest.mark.parametrize("name", core.QUERIES)
def test_query(name, spark, sf_dir, duck):
    df = core.QUERIES[name](spark, sf_dir)
    if name in core.ORACLES:
        same_rows(df, duck.sql(core.ORACLES[name]).df())
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
