"""Every query with an oracle against DuckDB on the smallest tables; the others run."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
HERE = sorted({**entry.scene.QUERIES, **entry.monitor.QUERIES, **entry.pipeline.QUERIES})


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, db, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    out = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(out.columns) == columns
    place = [out.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == Counter(tuple(plain(r[i]) for i in place) for r in out.fetchall())


@pytest.mark.parametrize("name", HERE)
def test_query(spark, db, sf, name):
    compare(spark, db, sf, name)


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["video_id", "event_no", "t"]
