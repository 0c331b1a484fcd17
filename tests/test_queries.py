"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import pytest

from strataforge import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 6)
    return str(v)[:19]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = duck.execute(registry.oracle_sql()[name])
    heads = [c[0] for c in rows.description]
    assert sorted(heads) == columns
    want = [tuple(plain(r[heads.index(c)]) for c in columns) for r in rows.fetchall()]
    have = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
