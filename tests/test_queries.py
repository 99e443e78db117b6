"""Every query of the catalog against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from cairnlake.plans.catalog import QUERIES
from cairnlake.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    said = duck.sql(ORACLES[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in said.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
