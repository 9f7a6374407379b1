"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from frameloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    rows = sorted(map(repr, (tuple(r) for r in got.collect())))
    if name not in catalogue.ORACLES:
        assert rows
        return
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert rows == sorted(map(repr, db.execute(f"select {columns} from ({catalogue.ORACLES[name]})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
