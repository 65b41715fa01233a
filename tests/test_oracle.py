"""Every registered query against its SQL at the smallest scale; queries without SQL must return rows."""

import pytest
from compare import compare, duck

from corpuslens.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that have no rows at the smallest scale; elsewhere empty on both sides proves nothing and fails.
EMPTY_AT_SMALLEST: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        difference = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
        assert difference is None or (difference.startswith("EMPTY") and name in EMPTY_AT_SMALLEST), difference
    else:
        assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
