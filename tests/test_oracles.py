"""Every registered query against its SQL twin on the smallest data set."""

import pytest
from check_oracles import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from perpflow.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) is None
