"""The keyed table: what is touched, what is read, and what a failed write leaves; histories in linear size."""

import pytest
from pyspark.sql import functions as F

from dialoom.operators import samples
from dialoom.sources.keyed import KeyedTable


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id bigint, v string")


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KeyedTable.create(spark, path, "id bigint, v string", "id", 8)
    assert t.read().count() == 0
    t.upsert(rows(spark, [(i, "a") for i in range(100)]))
    before = dict(t.versions)
    touched = t.upsert(rows(spark, [(5, "b"), (200, "c")]))
    assert 1 <= len(touched) <= 2 and {b for b in before if t.versions[b] != before[b]} == set(touched)
    again = KeyedTable(spark, path)
    got = {r.id: r.v for r in again.read().collect()}
    assert got == {i: "b" if i == 5 else "a" for i in range(100)} | {200: "c"}
    found = again.lookup(5)
    assert [r.v for r in found.collect()] == ["b"]
    files = found.inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    with pytest.raises(FileNotFoundError):
        again.lookup(9999)
    again.add_new(rows(spark, [(5, "late"), (300, "d"), (300, "d")]))
    again.delete(rows(spark, [(i, "") for i in range(50)]))
    got = {r.id: r.v for r in again.read().collect()}
    assert got == {i: "a" for i in range(50, 100)} | {200: "c", 300: "d"}
    assert again.vacuum() > 0 and {r.id: r.v for r in KeyedTable(spark, path).read().collect()} == got
    again.delete(rows(spark, [(i, "") for i in range(400)]))
    assert KeyedTable(spark, path).read().count() == 0


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KeyedTable.create(spark, path, "id bigint, v string", "id", 4)
    t.upsert(rows(spark, [(1, "a")]))
    with pytest.raises(Exception, match="no more"):
        t.upsert(rows(spark, [(1, "b"), (2, "b")]).withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("no more"))).otherwise(F.col("v"))))
    assert [tuple(r) for r in KeyedTable(spark, path).read().collect()] == [(1, "a")]
    t.upsert(t.read().withColumn("v", F.concat("v", F.lit("+"))))  # rows of the table itself
    assert [tuple(r) for r in t.read().collect()] == [(1, "a+")]


def test_long_conversations_keep_one_text(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("turn "), "id").alias("text"))
    told, ends = samples.histories(df).first(), {r.turn: r.upto for r in samples.history_ends(df).collect()}
    assert len(ends) == n and len(told.history) == sum(len(f"turn {i}") + 1 for i in range(n)) - 1
    assert told.history[: ends[3]] == "turn 0\x1fturn 1\x1fturn 2" and ends[0] == 0 and ends[n - 1] == len(told.history) - len(f"turn {n - 1}") - 1
