"""Every query of the catalogue against its SQL twin, over whole tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from rideflow.plans.catalog import QUERIES
from rideflow.plans.oracles import oracles
from tests.oracle import TESTDATA, connect, frame_rows, sql_rows

FOLDER = f"{TESTDATA}/sf0.001"
SQL_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    sql = oracle_sql()[name]
    result = queries()[name](spark, FOLDER)
    assert frame_rows(result) == sql_rows(con, sql)
    expected = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in result.schema} == expected


@pytest.mark.parametrize("name", ["rides_future", "rides_past", "rides_on_day"])
def test_rides_come_in_start_order(spark, name):
    rows = queries()[name](spark, FOLDER).collect()
    keys = [(r.started_at, r.ride_id) for r in rows]
    assert keys == sorted(keys) and len(keys) > 1


def test_every_query_of_the_catalogue_has_sql():
    assert set(QUERIES) == set(oracles())


def test_entry_is_the_flagship(spark):
    assert entry(spark).count() > 0
