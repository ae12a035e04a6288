"""Each query of the catalogue against DuckDB over the smallest tables."""

import math
import os

import pytest

from dialoom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents labels benchmark conversations events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_same_rows_whatever_the_partitions(name, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(repr, catalog.queries()[name](spark, SF).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert one == sorted(map(repr, catalog.queries()[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
