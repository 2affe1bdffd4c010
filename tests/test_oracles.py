"""Each registered query against its SQL, in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lakesync.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(None if x != x else x for x in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert rows(got) == rows(want) and (len(got) or name in ("buffer_snapshot", "flushed_between", "state_snapshot"))  # three hold no rows on tables this small


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 40
