"""Every registered query against its SQL on DuckDB."""

import oracle
import pytest

import __spark_entry__ as entry_points
from logweir.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.keys() <= entry_points.queries().keys() and ORACLES.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    query, sql = QUERIES[name], ORACLES[name]
    assert oracle.difference(spark, db, SF_DIR, query, sql) is None


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["start", "group", "count"]
