"""JSON of any shape in splits, and the search in nested JSON at any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dialoom.functions import nested
from dialoom.sources import json_items, scans

DEEP = '{"x":' * 100_000 + "1" + "}" * 100_000
SHAPES = {
    "array": ('[{"a": 1}, {"a": 2}]', [{"a": 1}, {"a": 2}], 0),
    "one": (' {"a": 1}\n', [{"a": 1}], 0),
    "indented": ('{\n "a": 1\n}\n{\n "a": 2\n}\n{broken', [{"a": 1}, {"a": 2}], 7),
    "plain": ('[1, "x", {"a":{"b":2}}, [3,{"c":1}], null, "tail"]', [1, "x", {"a": {"b": 2}}, [3, {"c": 1}], None, "tail"], 0),
    "strings": ('["a}","b\\"}{"]', ["a}", 'b"}{'], 0),
    "escapes": (r'{"a":"\\"}{"b":"}\\\""}{"c":"[{"}', [{"a": "\\"}, {"b": '}\\"'}, {"c": "[{"}], 0),
    "after": ('[{"a":{"b":1}} ] {"c":{"d":1}}\n{"e":1}', [{"a": {"b": 1}}, {"c": {"d": 1}}, {"e": 1}], 0),
    "nested": ('[[{"a":1}, 2], {"b":1}]', [[{"a": 1}, 2], {"b": 1}], 0),
    "cut": ('[{"a":1},{"b":', [{"a": 1}], 5),
    "middle": ('{"a":1}{oops}{"b":2}', [{"a": 1}, {"b": 2}], 6),
    "empty": ("", [], 0),
    "blank": (" \n\n", [], 0),
    "deep": (f'{{"a":1}}{DEEP}{{"b":2}}', [{"a": 1}, {"b": 2}], len(DEEP)),
}


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "10000")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_shapes(spark, tmp_path, small_splits):
    for n, (body, *_) in SHAPES.items():
        (tmp_path / f"{n}.json").write_text(body)
    rows = scans.read_any_json(spark, str(tmp_path)).withColumn("f", F.regexp_extract("path", r"(\w+)\.json", 1)).collect()
    for n, (_, items, unread) in SHAPES.items():
        mine = sorted((r for r in rows if r.f == n), key=lambda r: r.pos)
        assert [json.loads(r.item) for r in mine if r.item] == items, n
        assert sum(r.unread for r in mine if r.item is None) == unread, n
        assert len({r.pos for r in mine}) == len(mine)


def value(rng, k):
    return {"k": k, "t": rng.choice(["x}", '"{', "\\", "[", "ü}", "]"]) * rng.randint(0, 60), "n": [{"z": [1, {"y": "}"}]}] * rng.randint(0, 3)}


def test_one_file_in_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    items = [value(rng, k) for k in range(1500)]
    (tmp_path / "a.json").write_text(json.dumps(items, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(v, indent=1) for v in items))
    (tmp_path / "c.json").write_bytes(b"\xef\xbb\xbf" + "".join(json.dumps(v) for v in items).encode() + b'{"x":')
    rows = json_items.json_items(spark, str(tmp_path)).collect()
    for f in "abc":
        mine = sorted((r for r in rows if r.path.endswith(f"{f}.json")), key=lambda r: r.pos)
        assert [json.loads(r.item) for r in mine if r.item] == items
        assert [r.unread for r in mine if r.item is None] == ([5] if f == "c" else [])
    assert json_items.pieces(spark, str(tmp_path / "a.json")).select("start").distinct().count() > 5


def test_what_has_no_end_is_not_joined(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1}' + '{"b":[{}' * 1000)
    got = json_items.json_items(spark, str(tmp_path / "x.json"), max_item=500).collect()
    assert [(r.item, r.unread) for r in sorted(got, key=lambda r: r.pos)] == [('{"a":1}', 0), (None, 8000)]


def walk(x):
    if isinstance(x, dict):
        if "q" in x:
            yield x["q"]
        for v in x.values():
            yield from walk(v)
    elif isinstance(x, list):
        for v in x:
            yield from walk(v)


def tree(rng, depth=0):
    r = rng.random()
    if depth > 4 or r < 0.4:
        return rng.choice([1, -2.5, 's"}{', True, None, "", "é", 1e30, 0])
    if r < 0.7:
        return {rng.choice("qabc"): tree(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def test_keys_as_by_recursion_and_malformed_json_has_none():
    rng = random.Random(1)
    for _ in range(3000):
        v = tree(rng)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert [json.loads(x[3]) for x in nested.find_key(text, "q")] == list(walk(v))
        k = rng.randrange(len(text))
        bent = text[:k] + rng.choice(["", "{", "}", '"', ",", "x", "0", " "]) + text[k + 1 :]
        try:
            json.loads(bent, parse_constant=float)
            whole = "NaN" not in bent and "Infinity" not in bent
        except ValueError:
            whole = False
        assert (nested.find_key(bent, "q") is not None) == whole


def test_any_depth_and_by_sql(spark):
    n = 50_000
    rows = [(1, '{"x":[' * n + '{"q": "deep"}' + "]}" * n), (2, '{"a": {"q": 1}, "q": {"q": 3}}'), (3, "{broken"), (4, None), (5, '{"q": ""}'), (6, '{"q": true}')]
    spark.createDataFrame(rows, "id int, item string").createOrReplaceTempView("trees")
    nested.register(spark)
    first = {r.id: r.value for r in spark.sql("SELECT id, f.value FROM trees, LATERAL json_first(item, 'q') f").collect()}
    assert first == {1: "deep", 2: '{"q": 3}', 3: None, 4: None, 5: None, 6: "True"}
    found = [(r.id, r.ord, r.depth, r.path, r.value) for r in spark.sql("SELECT id, f.* FROM trees, LATERAL json_find(item, 'q') f WHERE id = 2 ORDER BY ord").collect()]
    assert found == [(2, 0, 0, "$.q", '{"q": 3}'), (2, 1, 1, "$.a.q", "1"), (2, 2, 1, "$.q.q", "3")]
