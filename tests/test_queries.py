"""Every core query against its SQL, over whole tables at the smallest scale."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from skeinlake.plans import data_queries, inventory_queries, reference_queries, source_queries

MODULES = (data_queries, reference_queries, source_queries, inventory_queries)
ALL = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else repr(v) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(data):
    db = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, data, duck, name):
    df = ALL[name](spark, data)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        found = duck.execute(SQL[name])
        assert got == rows_of([c[0] for c in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(set(df.columns))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p4_found", "p5_found"} <= set(entry.queries())
    assert entry.entry(spark).count() > 0
