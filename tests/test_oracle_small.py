"""Every registered query with an oracle agrees with DuckDB on the sf0.001 tables."""

import pytest

from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _names():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["status"] == "match", r
