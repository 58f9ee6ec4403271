"""Every registered query of this part against its SQL, on the smallest tables."""

import glob
import os

import pytest

from quillsift.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in catalog.SQL:
        assert rows
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    assert set(catalog.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
