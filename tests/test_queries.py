"""Every registered query against its SQL in another engine, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from gleanmark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    base = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        base.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return base


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert ours == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_flagship_has_rows(spark, sf):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, sf).count() > 0
