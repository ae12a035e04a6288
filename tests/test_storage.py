"""Sources, sinks, streams, configuration and dialogue control on small made-up files."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.operators import dialogue, personas, samples
from dialoom.sources import config, storage
from dialoom.streaming import usage as streams


def test_queries_of_several_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "", "query": "q1"}\n\nnot json\n"plain"\n{"conversations": [{"value": "c1"}]}\n')
    (tmp_path / "b.json").write_text(json.dumps({"queries": ["s1", {"text": "t1"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"prompt": "p1"}]))
    paths = [str(tmp_path / n) for n in ("a.jsonl", "missing.jsonl", "b.json", "c.json")]
    got = [(r.source, r.text) for r in storage.read_queries(spark, paths).orderBy("file_ord", "pos").collect()]
    assert got == [("a", "q1"), ("a", "plain"), ("a", "c1"), ("b", "s1"), ("b", "t1"), ("c", "p1")]
    assert storage.read_queries(spark, paths, 2).count() == 2
    assert storage.read_queries(spark, []).count() == 0


def test_any_json(spark, tmp_path):
    bodies = {"array": '[{"a": 1}, {"a": 2}]', "one": '{"a": 1}', "lines": '{"a": 1}\n{"a": 2}\n', "pretty": '{\n "a": 1\n}\n{\n "a": 2\n}\n{broken'}
    for n, b in bodies.items():
        (tmp_path / f"{n}.json").write_text(b)
    got = storage.read_any_json(spark, str(tmp_path)).groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).count().collect()
    assert {r.f: r["count"] for r in got} == {"array.json": 2, "one.json": 1, "lines.json": 2, "pretty.json": 2}


def test_strict_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbad\n')
    assert storage.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|bad record"):
        storage.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()


def test_lookup(spark):
    df = spark.range(3)
    assert storage.lookup(df, "id", 1).count() == 1
    with pytest.raises(FileNotFoundError):
        storage.lookup(df, "id", 9)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", "p"), ("b", ""), ("c", None)], "persona_id string, system_prompt string")
    for empty, n in ((True, 1), (False, 2)):
        storage.export_dataset(df, str(tmp_path / f"x{n}.json"), drop_empty=empty)
        assert spark.read.json(str(tmp_path / f"x{n}.json")).count() == n
    rows = spark.createDataFrame([("a: b", "p #1\n\"x\"", {"k": "yes"})], "persona_id string, system_prompt string, features map<string,string>")
    storage.export_dataset(rows, str(tmp_path / "y.yaml"))
    yaml = pytest.importorskip("yaml")
    body = "".join(p.read_text() for p in sorted((tmp_path / "y.yaml").glob("part-*")))
    assert yaml.safe_load(body) == [{"persona_id": "a: b", "system_prompt": 'p #1\n"x"', "features": {"k": "yes"}}]
    with pytest.raises(ValueError, match="unknown format"):
        storage.export_dataset(df, "x.csv")
    parts = storage.export_splits(samples.split(spark.range(25), "id", "s"), str(tmp_path / "s"))
    assert [spark.read.json(p).count() for p in parts] == [20, 2, 3]


def test_log_projection(spark):
    df = spark.createDataFrame([([(1, "x", [(1, 2)])],)], "states array<struct<a:int,b:string,rollouts:array<struct<r:int,s:int>>>>")
    got = df.select(storage.project_log(F.col("states"), ["a"], ["s"]).alias("s")).first().s[0]
    assert got.asDict(recursive=True) == {"a": 1, "rollouts": [{"s": 2}]}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("m1", 1, 2, "2024-01-01 00:10:00", 1), ("m1", 3, 4, "2024-01-01 00:20:00", 1), ("m2", 5, 6, "2024-01-01 07:00:00", 2)]
    df = spark.createDataFrame(rows, "module string, input_tokens int, output_tokens int, ts string, user_id int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(src))
    q = streams.running_module_totals(streams.read_stream(spark, str(src), df.schema)).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.module: r.total_tokens for r in spark.table("totals").collect()} == {"m1": 10, "m2": 11}
    q = streams.append_log(streams.read_stream(spark, str(src), df.schema), str(tmp_path / "log"), str(tmp_path / "cp"), lambda x: x.select("module"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    for f, name in ((streams.windowed_totals, "w"), (streams.sessions, "s")):
        q = f(streams.read_stream(spark, str(src), df.schema)).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("w").count() == 1 and spark.table("s").first().calls == 2


def test_config(monkeypatch):
    c = {"assistant": {"models": [{"name": "a", "weight": 0.5}]}, "personas": {"count": 0}, "sampling": {"least": 3, "most": 2}}
    assert [x.status for x in config.validate(c)] == ["FAIL"] * 3
    assert config.tally(config.validate({"split": {"train": 0.8, "val": 0.1, "test": 0.1}})) == {"PASS": 1, "WARN": 0, "FAIL": 0}
    monkeypatch.setenv("SOME_KEY", "k")
    assert config.resolve_key("your-api-key", ("SOME_KEY",)) == ("k", "SOME_KEY")
    assert config.resolve_key("real", ()) == ("real", "config")
    assert [config.batch_size(v, 10) for v in (3, 0, "x", 99)] == [3, 10, 10, 10]
    with pytest.raises(ValueError, match="sum"):
        config.model_pool([{"name": "a", "weight": 0.4}])


def test_dialogues_retry_and_supplement(spark):
    tasks = spark.createDataFrame([(i, f"q {i}", "p", 3) for i in range(12)], "task_id bigint, query string, persona string, target_turns int")
    got = dialogue.simulate(tasks, dialogue.MockClient(empty_every=3), retries=0)
    assert 0 < got.count() < 12
    again = dialogue.supplement(tasks, dialogue.MockClient(), rounds=2)
    rows = again.collect()
    assert len(rows) == 12 and all(r.messages[0].role == "user" and r.messages[1].role == "assistant" for r in rows)
    calls = []
    assert dialogue.with_retries(lambda: calls.append(1), 3) == (None, 3) and len(calls) == 3


def test_personas(spark):
    bank = personas.default_bank()
    p = personas.sample_personas(spark.range(50).withColumnRenamed("id", "persona_id"), bank, "t", least=15, most=20, required=("dim_05",))
    for r in p.collect():
        names = [f.name for f in r.features]
        assert 15 <= len(names) <= 20 and "dim_05" in names and [f.ord for f in r.features] == sorted(f.ord for f in r.features)
        assert all(f.value in personas.dimension(bank, f.name).values for f in r.features)
    few = personas.default_bank()[:4]
    close = personas.diverse_personas(spark.range(12).withColumnRenamed("id", "persona_id"), few, "d", min_distance=2, max_attempts=20, least=3, most=4)
    assert close.count() == 12 and personas.close_pairs(close, 2).count() == 0
    with pytest.raises(KeyError):
        personas.dimension(bank, "nope")
    with pytest.raises(ValueError, match="unknown strategy"):
        personas.strategy({"strategy": "odd"})
    with pytest.raises(ValueError, match="lacks"):
        personas.validate([personas.Dimension("a", "x", False, ())])
