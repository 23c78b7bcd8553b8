"""Every registered query against its SQL oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from tests.conftest import SMALL
from vacantia.plans import catalog

# Queries without rows at this size: no page links to a job board.
MAY_BE_EMPTY = {"html_job_links", "duplicate_keys"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    cur = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == canonical(columns, cur.fetchall())
    assert got or name in MAY_BE_EMPTY


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "run_id", "id", "alert_no", "content"]
    assert df.count() > 0
