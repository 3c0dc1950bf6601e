"""Every registered query against its check SQL on the smallest given tables."""

import duckdb
import pytest

from placewright.plans import load
from verify_local import TABLES, rows_of

QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, sf, db, name):
    frame = QUERIES[name](spark, sf)
    got = rows_of(frame.columns, frame.collect())
    cursor = db.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())
