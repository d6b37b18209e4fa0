"""Queries of the subpackage against their SQL on DuckDB."""

import oracle
import pytest

import __spark_entry__ as entry_points
from logweir.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    assert oracle.difference(spark, db, SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_targets_of_the_mix(spark, db):
    """What SQL can say of op7: sizes, and targets that no other round of sharing changes."""
    found = QUERIES["op7_mixing"](spark, SF_DIR).toPandas()
    sql = r"SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents"
    known = db.execute(sql).fetch_df()
    both = found.merge(known, on="doc_id", suffixes=("", "_known"))
    assert len(both) == len(found) == len(known) and (both["size"] == both["size_known"]).all()
    by_source = both.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), n=("target", "nunique"))
    assert (by_source["size"] == by_source["source_size"]).all() and (by_source["n"] == 1).all()
    weights = [(5, 2, 1)[k % 3] for k in range(len(by_source))]
    capped = by_source["target"] >= 2 * by_source["size"] - 1e-6
    assert by_source["target"].sum() == pytest.approx(1.5 * by_source["size"].sum())
    levels = (by_source["target"] / weights)[~capped]
    assert levels.max() == pytest.approx(levels.min()) and ((by_source["target"] / weights)[capped] <= levels.max() + 1e-6).all()


def test_entry_points():
    assert QUERIES.keys() <= entry_points.queries().keys() and ORACLES.items() <= entry_points.oracle_sql().items()
