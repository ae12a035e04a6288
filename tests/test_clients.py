"""Clients with a stub transport, pools, usage, banks, close pairs, scans and renderers on small made-up files."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from dialoom.operators import clients, dialogue, personas, samples, usage
from dialoom.sources import scans, storage


def answer(url, headers, body, seconds):
    said = f"{body['model']}:{body['messages'][0]['content']} "
    if url.endswith("/messages"):
        return {"content": [{"text": said}], "usage": {"input_tokens": 3, "output_tokens": 4}}
    return {"choices": [{"message": {"content": said}}], "usage": {"prompt_tokens": 5, "completion_tokens": 6}}


def test_factory(monkeypatch):
    for name in clients.BASES:
        monkeypatch.delenv(clients.key_variable(name), raising=False)
    assert isinstance(clients.create_client({}), dialogue.MockClient)
    assert isinstance(clients.create_client({"provider": "other", "api_key": clients.UNSET_KEY}), dialogue.MockClient)
    with pytest.raises(ValueError, match="unknown provider"):
        clients.create_client({"provider": "other", "api_key": "k"})
    a = clients.create_client({"api_key": "k", "endpoint": "https://h/v1/chat/completions", "inference": {"max_tokens": 9, "top_p": 0.5}}, answer)
    url, headers, body = a.request("p")
    assert (a.provider, a.model, url) == ("openai", "gpt-4o-mini", "https://h/v1/chat/completions")
    assert headers == {"Authorization": "Bearer k"} and (body["max_completion_tokens"], body["top_p"], body["temperature"]) == (9, 0.5, 0.7)
    assert a.generate_with_tokens("p") == ("gpt-4o-mini:p", 5, 6)
    monkeypatch.setenv("ANTHROPIC_API_KEY", "e")
    b = clients.create_client({"provider": "Anthropic", "model": "m", "headers": {"x": "y"}}, answer)
    url, headers, body = b.request("p")
    assert b.key is None and url == "https://api.anthropic.com/v1/messages" and headers["x-api-key"] == "e" and headers["x"] == "y"
    assert body["max_tokens"] == 2048 and "max_completion_tokens" not in body and b.generate_with_tokens("p") == ("m:p", 3, 4)
    monkeypatch.delenv("ANTHROPIC_API_KEY")
    with pytest.raises(RuntimeError, match="ANTHROPIC_API_KEY"):
        b.generate("p")
    assert clients.create_client({"provider": "openrouter", "api_key": "k", "base_url": "https://r/"}, answer).request("p")[0] == "https://r/chat/completions"
    with pytest.raises(RuntimeError, match="another shape"):
        clients.HttpClient("openai", "m", "b", key="k", transport=lambda *a: {"choices": []}).generate("p")


def test_pool_keeps_the_order_and_its_bound():
    now, most, lock = 0, 0, threading.Lock()

    def slow(x):
        nonlocal now, most
        with lock:
            now, most = now + 1, max(most, now + 1)
        time.sleep(0.002 * (x % 3))
        with lock:
            now -= 1
        return 2 * x

    assert list(clients.pooled(slow, range(60), 4)) == [2 * x for x in range(60)]
    assert 1 < most <= 4
    taken = []
    it = clients.pooled(slow, (taken.append(x) or x for x in range(1000)), 4)
    next(it)
    assert len(taken) <= 9
    it.close()
    assert list(clients.pooled(slow, [], 4)) == [] and list(clients.pooled(slow, [1], 1)) == [2]
    with pytest.raises(ZeroDivisionError):
        list(clients.pooled(lambda x: 1 // x, [1, 0], 3))


def flaky():
    """A client that fails on some prompts and is empty on others; made here so that it travels by value."""

    class Flaky:
        provider, model = "stub", "one"

        def generate_with_tokens(self, prompt):
            n = len(prompt)
            if n % 5 == 0:
                raise TimeoutError(prompt)
            return ("" if n % 7 == 0 else f"said {prompt}"), n, 2

    return Flaky()


def test_usage_equals_the_calls(spark):
    df = spark.range(1, 41).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("p"))
    got = dialogue.ask(df, flaky(), "p", "said", attempts=2, usage="calls")
    rows = {r.id: r for r in got.collect()}
    for i, r in rows.items():
        failed, empty = i % 5 == 0, i % 7 == 0
        assert r.said == ("" if failed or empty else "said " + "x" * i)
        assert len(r.calls) == (0 if failed else 2 if empty else 1)
    used = dialogue.usage_rows(got, flaky(), "asking", "calls")
    total = {(r.scope, r.name): r for r in usage.totals(used).collect()}
    calls = [c for r in rows.values() for c in r.calls]
    assert total["all", ""].calls == len(calls) == total["module", "asking"].calls == total["model", "stub/one"].calls
    assert total["all", ""].input_tokens == sum(c.input_tokens for c in calls)


def test_dialogues_with_usage(spark, tmp_path):
    tasks = spark.range(30).select(F.col("id").alias("task_id"), F.concat(F.lit("q"), "id").alias("query"), F.lit("p").alias("persona"), F.lit(3).alias("target_turns"))
    plain = {r.task_id: r.messages for r in dialogue.simulate(tasks, dialogue.MockClient(empty_every=6), retries=0, workers=1).collect()}
    got = dialogue.simulate(tasks, dialogue.MockClient(empty_every=6), retries=0, workers=8, usage=True)
    rows = {r.task_id: r for r in got.collect()}
    assert len(rows) == 30 and {i: r.messages for i, r in rows.items() if r.messages} == plain
    assert all(len(r.usage) >= sum(m.role == "assistant" for m in r.messages or ()) for r in rows.values())
    out = usage.export(dialogue.usage_rows(got, dialogue.MockClient(), "dialogue"), str(tmp_path / "u"))
    assert [spark.read.json(p).count() for p in out] == [3, sum(len(r.usage) for r in rows.values())]


def test_scores_in_one_pass(spark):
    c = dialogue.MockClient()
    df = spark.createDataFrame([(1, "one"), (2, None), (3, "x" * 5000)], "k int, q string")
    for r in dialogue.score_responses(df, c, "k", "q").collect():
        q = {1: "one", 2: None, 3: "x" * 5000}[r.k]
        said = c.generate("" if q is None else f"ANSWER\n{q}")[:2000]
        want = [int(c.generate(f"JUDGE {w}\n{said}").split()[1]) for w in ("persona", "task")]
        assert [r.scores.persona_score, r.scores.task_score] == want


# ---- banks, strategies, distances


def test_bank_and_strategies_from_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text("dimensions:\n  - name: a\n    category: basic_info\n    is_constraint: true\n    values: [x, 18_24, 1]\n  - name: b\n    values: [y]\n")
    assert personas.read_bank(str(tmp_path / "b.yaml")) == [personas.Dimension("a", "basic_info", True, ("x", "1824", "1")), personas.Dimension("b", "", False, ("y",))]
    (tmp_path / "none.yaml").write_text("other: 1\n")
    assert personas.read_bank(str(tmp_path / "none.yaml")) == []
    (tmp_path / "bad.yaml").write_text("dimensions:\n  - name: a\n")
    with pytest.raises(ValueError, match="lacks"):
        personas.read_bank(str(tmp_path / "bad.yaml"))
    layers, tables = dialogue.load_strategies(str(tmp_path / "missing.yaml"))
    assert sum(w for _, w in layers) == pytest.approx(1) and sum(m for _, m, _ in tables["surface_noise"]) == 2
    (tmp_path / "s.json").write_text(json.dumps({"layer_weights": {"l": 2, "m": 2}, "strategies": {"l": {"s": {"mandatory": True}, "t": {"probability": 0.25}}}}))
    assert dialogue.load_strategies(str(tmp_path / "s.json")) == ([("l", 0.5), ("m", 0.5)], {"l": [("s", True, 0.0), ("t", False, 0.25)]})


def test_close_pairs_and_the_mean(spark):
    bank = [personas.Dimension(f"d{i}", "basic_info", False, ("a", "b")) for i in range(6)]
    drawn = personas.sample_personas(spark.range(40).withColumnRenamed("id", "persona_id"), bank, "s", least=3, most=6).cache()
    ids = drawn.select("persona_id")
    every = ids.select(F.col("persona_id").alias("i")).crossJoin(ids.select(F.col("persona_id").alias("j"))).where("i < j")
    all_pairs = {(r.i, r.j): r.distance for r in personas.distances(drawn, every).collect()}
    rows = {r.persona_id: {f.name: f.value for f in r.features} for r in drawn.collect()}
    plain = {(i, j): sum(x.get(k) != y.get(k) for k in x.keys() | y.keys()) for i, x in rows.items() for j, y in rows.items() if i < j}
    assert all_pairs == plain
    heavy = {(r.i, r.j): r.distance for r in personas.distances(drawn, every, ("d0", "d3"), 3).collect()}
    assert heavy == {(i, j): sum((3 if k in ("d0", "d3") else 1) for k in x.keys() | y.keys() if x.get(k) != y.get(k)) for i, x in rows.items() for j, y in rows.items() if i < j}
    with pytest.raises(ValueError, match="too few"):
        personas.close_pairs(drawn, 7)
    for least in (1, 2, 3, 5):
        got = {(r.i, r.j): r.distance for r in personas.close_pairs(drawn, least).collect()}
        assert got == {p: d for p, d in plain.items() if d < least}
    mean = personas.mean_distance(drawn).first()
    assert mean.n == 40 and mean.distance == pytest.approx(sum(plain.values()) / len(plain))


# ---- scans


def test_patterns_and_merge_folders(spark, tmp_path):
    for n in ("train_samples_b.json", "train_samples_a.json", "statistics.json", "index.json"):
        (tmp_path / n).write_text("[]")
    names = lambda paths: [p.rsplit("/", 1)[-1] for p in paths]
    assert names(scans.resolve_inputs(spark, [f"{tmp_path}/stat*", f"{tmp_path}/none.json", f"{tmp_path}/*.json"], "train_samples_")) == ["train_samples_a.json", "train_samples_b.json"]
    assert names(scans.resolve_inputs(spark, [f"{tmp_path}/statistics.json", f"{tmp_path}/train_samples_a.json"])) == ["statistics.json", "train_samples_a.json"]
    by_name = ["statistics.json", "train_samples_a.json", "train_samples_b.json"]
    assert names(scans.merge_files(spark, str(tmp_path))) == by_name
    (tmp_path / "index.json").write_text(json.dumps({"interactions": [{"filepath": "train_samples_b.json"}, {"filepath": ""}, {"x": 1}, {"filepath": f"{tmp_path}/statistics.json"}]}))
    assert names(scans.merge_files(spark, str(tmp_path))) == ["train_samples_b.json", "statistics.json"]
    assert names(scans.merge_files(spark, str(tmp_path), use_index=False)) == by_name
    (tmp_path / "index.json").write_text("{broken")
    assert names(scans.merge_files(spark, str(tmp_path))) == by_name


def test_sample_lists_and_stores(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"n": 1}, {"n": 2}]')
    (tmp_path / "a.json").write_text('[{"n": 3}]')
    got = scans.read_samples(spark, [f"{tmp_path}/b.json", f"{tmp_path}/a.json"]).orderBy("file_ord", "pos").collect()
    assert [(r.file_ord, r.pos, json.loads(r.item)["n"]) for r in got] == [(0, 0, 1), (0, 1, 2), (1, 0, 3)]
    with pytest.raises(Exception, match="no JSON array"):
        scans.read_samples(spark, [f"{tmp_path}/missing.json"]).collect()
    store = tmp_path / "store"
    store.mkdir()
    (store / "p1.json").write_text(json.dumps({"queries": [{"query_id": "s:1", "text": "a"}, {"query_id": "s:1", "text": "again"}, "no object", {"source": "s", "text": "b"}]}))
    (store / "p2.json").write_text(json.dumps([{"id": "7", "source": "t", "text": "c"}]))
    (store / "p3.json").write_text("{broken")
    (store / "p4.json").write_text("3")
    rows = {(r.persona_id, r.pos): r.query_id for r in scans.read_store(spark, str(store)).collect()}
    assert set(rows) == {("p1", 0), ("p1", 3), ("p2", 0)} and rows["p1", 0] == "s:1" and rows["p1", 3].startswith("hash:") and rows["p2", 0] == "t:7"
    assert scans.read_store(spark, str(store), "p2").count() == 1 and scans.read_store(spark, str(store), "none").count() == 0


def test_any_json_says_what_it_left(spark, tmp_path):
    bodies = {
        "array": '[{"a": 1}, {"a": 2}]',
        "one": '{"a": 1}',
        "lines": '\n{"a": 1}\nbroken line\n{"a": 2}\n',
        "pretty": '{\n "a": 1\n}\n{\n "a": 2\n}\n{broken',
        "empty": "\n \n",
    }
    for n, b in bodies.items():
        (tmp_path / f"{n}.json").write_text(b)
    got = scans.read_any_json(spark, str(tmp_path)).withColumn("f", F.regexp_extract("path", r"(\w+)\.json", 1)).collect()
    items = {f: [json.loads(r.item)["a"] for r in sorted(got, key=lambda r: r.pos) if r.f == f and r.item] for f in bodies}
    assert items == {"array": [1, 2], "one": [1], "lines": [1, 2], "pretty": [1, 2], "empty": []}
    assert {r.f: r.unread for r in got if r.item is None} == {"lines": len("broken line"), "pretty": len("{broken")}
    assert all(r.unread == 0 for r in got if r.item)


def test_interactions_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([("i1", "p", 2), ("i2", "p", 1)], "interaction_id string, persona_id string, num_turns int")
    assert scans.save_interactions(df, str(tmp_path / "s")).count() == 2
    again = scans.save_interactions(df.limit(1).withColumn("num_turns", F.lit(9)).unionByName(spark.createDataFrame([("i3", "q", 5)], df.schema)), str(tmp_path / "s"), F.struct("interaction_id"))
    assert {r.interaction_id for r in again.collect()} == {"i1", "i2", "i3"}
    assert spark.read.json(str(tmp_path / "s" / "index")).count() == 3
    at = samples.export_statistics(spark.createDataFrame([("p", 2, ["a", "b"])], "persona_id string, num_turns int, prompt_trajectory array<string>"), str(tmp_path / "t"), stamp=False)
    said = spark.read.json(at).first()
    assert (said.total_samples, said.total_prompts, at.endswith("/statistics")) == (1, 2, True)


def test_query_ids_of_malformed_samples(spark):
    df = spark.createDataFrame([('{"metadata": {"query_id": "a"}}',), ('{"x": [{"query_id": "b"}]}',), ("{broken",), (None,)], "item string")
    assert {r.item: r.query_id for r in storage.with_query_id(df, "item").collect()} == {'{"metadata": {"query_id": "a"}}': "a", '{"x": [{"query_id": "b"}]}': "b", "{broken": None, None: None}
