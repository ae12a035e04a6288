"""Watched runs: the stream's state against the batch form, late steps, idle runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import evaluation
from dialoom.streaming import state
from dialoom.streaming import usage as streams

SCHEMA = "run bigint, step bigint, rate double, tokens bigint, at timestamp"
START = dt.datetime(2024, 1, 1)


def rows_of(rng, n):
    return [(rng.randint(0, 6), k, rng.choice([0.0, 0.5, 1.0, 1.0]), rng.randint(0, 9), START + dt.timedelta(minutes=k)) for k in range(n)]


def written(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def ran(spark, tmp_path, **how):
    stream = streams.read_stream(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)
    state.watched_runs(stream, **how).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return [tuple(r) for r in spark.read.schema(state.WATCHED).parquet(str(tmp_path / "out")).collect()]


def shown(rows):
    return sorted((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9), r[4]) for r in rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_as_batch(spark, tmp_path, parts):
    rng = random.Random(3)
    rows = rows_of(rng, 400)
    cut = len(rows) // parts
    batches = [rows[k * cut : (k + 1) * cut] for k in range(parts)]
    for b in batches:
        rng.shuffle(b)  # within a batch steps come in any order
    written(spark, tmp_path / "in", batches)
    got = ran(spark, tmp_path, limit=0.6, idle="1000 days")
    want = evaluation.watched_runs(spark.createDataFrame(rows, SCHEMA), 5, 0.6).collect()
    assert shown(got) == shown(want)
    assert {r[2] for r in got} == {"step", "abort"}


def test_late_steps_and_idle_runs(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    written(spark, tmp_path / "in", [[(1, 1, 1.0, 5, at(0)), (1, 3, 0.0, 5, at(1))], [(1, 2, 1.0, 7, at(2)), (2, 1, 1.0, 1, at(200))], [(2, 2, 0.0, 1, at(400))], [(1, 1, 0.25, 2, at(401)), (2, 2, 1.0, 9, at(401))]])
    got = shown(ran(spark, tmp_path, idle="60 minutes"))
    assert (1, 2, "late", None, None) in got and (2, 2, "late", None, None) in got
    assert (1, 3, "end", 0.5, 10) in got  # idle since minute 1, seen when the watermark is past
    assert (1, 1, "step", 1.0, 5) in got and (1, 1, "step", 0.25, 2) in got  # after its end a run begins anew
    assert (2, 2, "step", 0.5, 2) in got


def test_batch_form_aborts_once_and_only_on_full_windows(spark):
    rows = [(1, k, 1.0, 1, START) for k in range(8)] + [(2, k, 1.0, 1, START) for k in range(4)] + [(3, k, 0.8, 1, START) for k in range(9)]
    got = evaluation.watched_runs(spark.createDataFrame(rows, SCHEMA), 5, 0.8).where(F.col("event") == "abort").collect()
    assert [(r.run, r.step, r.tokens) for r in got] == [(1, 4, 5)]
