"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import pytest

from tallywright import registry

from .compare import duck, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    got = spark_rows(registry.queries()[name](spark, SF))
    want = duck_rows(con, registry.oracle_sql()[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, SF).collect()
