"""Each core query equals its DuckDB counterpart on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(table) -> list:
    names = sorted(table.column_names)
    return sorted(repr([r[n] for n in names]) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_equals_oracle(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, FOLDER).toArrow(), duck.sql(catalogue.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)
