"""The commit log: whole commits only, retried tasks, restarted streams, and the recorder."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dialoom.sources import commitlog
from dialoom.streaming import usage as streams

ROOT = Path(__file__).resolve().parents[1]

FAILING = """
import sys
from pyspark import TaskContext
from dialoom.session import local_session
from dialoom.sources import commitlog

spark = local_session("2,3", "failing", 2)
path = sys.argv[1]

def fail_once(batches):
    for b in batches:
        yield b
    task = TaskContext.get()
    if task.partitionId() == 1 and task.attemptNumber() == 0:
        raise RuntimeError("the first attempt dies after it has written its rows")

def fail_always(batches):
    yield from batches
    raise RuntimeError("no attempt ends")

rows = spark.range(0, 1000, 1, 4)
commitlog.append(rows.mapInArrow(fail_once, "id bigint"), path)
try:
    commitlog.append(rows.mapInArrow(fail_always, "id bigint"), path)
except Exception:
    pass
print("COUNT", commitlog.read(spark, path).count(), commitlog.read(spark, path, "id bigint").select("id").distinct().count())
"""


def test_a_retried_task_writes_nothing_twice(tmp_path):
    (tmp_path / "job.py").write_text(FAILING)
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(tmp_path / "log")], capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": str(ROOT)})
    assert "COUNT 1000 1000" in done.stdout, done.stderr[-2000:]
    named = {f for _, files in commitlog.commits(str(tmp_path / "log")) for f, _ in files}
    there = {p.name for p in (tmp_path / "log").glob("part-*")}
    assert named < there  # what the dead attempts wrote lies there and is not read


def test_commits_in_order_and_nothing_before_them(spark, tmp_path):
    path = str(tmp_path / "log")
    assert commitlog.read(spark, path).count() == 0
    for k in range(3):
        commitlog.append(spark.range(5).select(F.lit(k).alias("k"), F.col("id").alias("a b"), F.lit(None).cast("string").alias("none")), path)
    (tmp_path / "log" / "part-stray.jsonl").write_text('{"k": 9}\n')
    (tmp_path / "log" / "_commits" / "half.json.x").write_text("{")
    got = commitlog.read(spark, path, "k int, `a b` bigint").collect()
    assert Counter((r.k, r["a b"]) for r in got) == Counter((k, i) for k in range(3) for i in range(5))
    by = sorted({(r.commit, r.k) for r in got})
    assert [k for _, k in by] == [0, 1, 2]
    with pytest.raises(Exception, match="only appended"):
        spark.range(1).select(F.lit("x")).write.format("commit_log").mode("overwrite").save(path)


def test_empty_partitions_and_empty_tables(spark, tmp_path):
    commitlog.append(spark.range(0), str(tmp_path / "a"))
    commitlog.append(spark.range(1).repartition(4), str(tmp_path / "a"))
    assert commitlog.read(spark, str(tmp_path / "a")).count() == 1
    assert len(list((tmp_path / "a").glob("part-*"))) == 1


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "log")
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(src))
    stream = streams.read_stream(spark, str(src), "id bigint", per_trigger=1)
    commitlog.append_stream(stream, path, str(tmp_path / "cp"), "s").awaitTermination()
    assert sorted(r.id for r in commitlog.read(spark, path, "id bigint").collect()) == list(range(30))
    # the last batch is tried again, as after a crash between the commit and the checkpoint
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "cp" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    spark.range(30, 35).coalesce(1).write.mode("append").parquet(str(src))
    commitlog.append_stream(stream, path, str(tmp_path / "cp"), "s").awaitTermination()
    assert sorted(r.id for r in commitlog.read(spark, path, "id bigint").collect()) == list(range(35))


def test_recorder(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(RuntimeError), commitlog.Recorder(spark, path, rows=10) as log:
        for step in [*range(7), 3]:
            log.record(step, loss=step / 2, reward=log.count)
        raise RuntimeError
    got = {(r.step, r.name): r.value for r in commitlog.metrics(spark, path).collect()}
    assert len(commitlog.commits(path)) == 2
    assert got == {(s, "loss"): s / 2 for s in range(7)} | {(s, "reward"): 7.0 if s == 3 else float(s) for s in range(7)}
    assert json.loads(commitlog.read(spark, path).first().value).keys() == {"step", "name", "value", "seq"}
