"""The field that an item's query is taken from, with empty and missing fields."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.plans import catalog


def test_first_or_last_is_pythons_or(spark):
    rows = list(product(("", None, "a"), ("", None, "b"), ("", None, "c")))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "x string, y string, z string, i int")
    got = dict(df.select("i", text.first_or_last(F.col("x"), F.col("y"), F.col("z"))).collect())
    assert [got[i] for i in range(len(rows))] == [x or y or z for x, y, z in rows]


def test_query_coalesce_of_empty_and_missing_fields(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    fields = list(product(("", None, " ", "a text"), ("", None, "en"), ("", None, "src0")))
    # every combination under every remainder of an id by 6, ids below zero, and without an id
    rows = [(6 * n + k, *f) for n, f in enumerate(fields, -len(fields) // 2) for k in range(6)] + [(None, *f) for f in fields]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()["p22_query_coalesce"]).fetchall()
    got = catalog.queries()["p22_query_coalesce"](spark, str(tmp_path)).collect()
    assert len(want) == len(rows) and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
