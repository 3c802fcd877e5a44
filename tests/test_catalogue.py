"""Each query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

from __future__ import annotations

import os

import duckdb
import pytest

from exposark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    frame = catalogue.QUERIES[name](spark, SF)
    assert frame.columns
    frame.collect()
