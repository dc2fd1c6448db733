"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from filingloom.plans import derived, grids, groups, nested, registry, retrieval, tables, texts  # noqa: F401

DATA = "/root/testdata"


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db():
    def connect(sf):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for f in glob.glob(f"{DATA}/{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
        return con

    return {sf: connect(sf) for sf in ("sf0.001", "sf0.01")}


#: A Python call for each of many small sheets takes a minute at the larger size.
SLOW = {"enhanced_index"}


@pytest.mark.parametrize(("name", "sf"), [(n, sf) for n in sorted(registry.QUERIES) for sf in ("sf0.001", "sf0.01") if sf == "sf0.001" or n not in SLOW])
def test_against_sql(spark, db, name, sf):
    df, db = registry.QUERIES[name](spark, f"{DATA}/{sf}"), db[sf]
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    found = db.sql(registry.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in found.fetchall()], key=str)
