"""Every registered layout query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quire.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows(table):
    table = table.select(sorted(table.column_names))
    return sorted((tuple(map(plain, r)) for r in zip(*(c.to_pylist() for c in table.columns), strict=True)), key=str) if table.num_columns else []


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toArrow()
    want = duck.sql(catalog.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
