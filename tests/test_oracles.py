"""Every registered query at the smallest scale: against DuckDB where SQL can say it."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert difference(got, con.sql(ORACLES[name]).df()) == ""
    else:
        assert len(got.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
