"""Column functions against plain statements of what they mean."""

import math

import pytest
from pyspark.sql import functions as F

from dialoom.functions import arith, noise, rand, text


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(("said", "want"), [("4", 0.75), ("Score: 4/5", 0.75), ("0.8", 0.8), ("7", 1.0), ("-3", 0.0), ("1", 0.0), ("", 0.0), ("8.5", 1.0), ("none", 0.0)])
def test_unit_score(spark, said, want):
    assert one(spark, text.unit_score(F.col("s")), s=said) == want


@pytest.mark.parametrize(("said", "want"), [("4", 4), ("Score: 4/5", 4), ("8.5", 8), ("99", 10), ("0", 1), ("", 5), ("x7", 5)])
def test_ten_score(spark, said, want):
    assert one(spark, text.ten_score(F.col("s")), s=said) == want


@pytest.mark.parametrize(("said", "want"), [("win", 1.0), ("Lose", 0.0), (" tie ", 0.0), ("B wins", 1.0), ("draw", 0.0), ("", 0.0)])
def test_verdict(spark, said, want):
    assert one(spark, text.verdict(F.col("s")), s=said) == want


def test_json_recovery(spark):
    assert one(spark, text.json_object(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"b": 1}'
    assert one(spark, text.json_object(text.unfenced(F.lit('```json\n{"a": {"b": 1}}\n```')))) == '{"a": {"b": 1}}'
    assert one(spark, text.json_object(F.lit("garbage"))) is None


def test_feedback(spark):
    f = lambda s: one(spark, text.feedback(F.lit(s)))
    assert f('{"satisfied": true, "feedback": "much longer"}') is None
    assert f('{"feedback": "much longer"}') == "much longer"
    assert f('{"feedback": "short"}') is None
    assert f("not json but long") == "not json but long"
    assert f("tiny") is None


def test_noise_keeps_its_promises(spark):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(40)] + [(90, "one"), (91, ""), (92, "a b")], "k int, t string").cache()
    got = {r.k: r for r in df.select("k", "t", noise.typos(F.col("t"), F.col("k")).alias("typo"), noise.swaps(F.col("t"), F.col("k")).alias("swap"), noise.deletions(F.col("t"), F.col("k")).alias("gone"), noise.insertions(F.col("t"), F.col("k")).alias("more")).collect()}
    for i in range(40):
        r = got[i]
        assert len(r.typo) == len(r.t) and sum(a != b for a, b in zip(r.typo, r.t, strict=True)) <= 2
        assert sorted(r.swap.split()) == sorted(words)
        assert len(r.gone.split()) == 19 and [w for w in words if w in r.gone.split()] == r.gone.split()
        assert len(r.more) > len(r.t) and set(words) <= set(r.more.split())
    assert got[90].swap == got[90].gone == "one" and got[91].typo == got[91].more == "" and got[92].gone == "a b"


def test_synonyms(spark):
    got = one(spark, noise.synonyms(F.lit("Big big big big big big big"), F.lit(1)))
    assert set(got.lower().split()) <= {"big", *noise.SYNONYMS["big"]} and got[0].isupper()


def test_uniform_is_even_and_reproducible(spark):
    x = [r.u for r in spark.range(2000).select(rand.uniform("s", "id").alias("u")).collect()]
    assert all(0 < u < 1 for u in x) and abs(sum(x) / len(x) - 0.5) < 0.02
    assert x == [r.u for r in spark.range(2000).repartition(7).select("id", rand.uniform("s", "id").alias("u")).orderBy("id").collect()]


def test_normal(spark):
    x = [r.u for r in spark.range(4000).select(rand.normal("s", 3.0, 0.5, "id").alias("u")).collect()]
    m = sum(x) / len(x)
    assert abs(m - 3) < 0.05 and abs(math.sqrt(sum((v - m) ** 2 for v in x) / len(x)) - 0.5) < 0.03


def test_losses(spark):
    new, old = F.array(F.lit(-1.0), F.lit(-2.0)), F.array(F.lit(-1.5), F.lit(-1.0))
    got = one(spark, arith.clipped_loss(new, old, F.lit(2.0)))
    r = [math.exp(0.5), math.exp(-1.0)]
    assert got == pytest.approx([-min(x * 2, min(max(x, 0.8), 1.2) * 2) for x in r])
    assert one(spark, arith.kl_terms(new, old)) == pytest.approx([math.exp(-d) + d - 1 for d in (0.5, -1.0)])
    assert one(spark, arith.masked_mean(new, F.array(F.lit(0.0), F.lit(0.0)))) == 0


def test_conversation_text(spark):
    m = [("system", "be"), ("user", "hi"), ("assistant", ""), ("assistant", "yo"), ("user", "")]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    assert df.select(text.conversation_text(F.col("m"))).first()[0] == "System: be\nUser: hi\nyo"
    assert df.select(text.conversation_text(F.col("m"), False)).first()[0] == "System: be\nUser: hi\n[ASSISTANT_RESPONSE]\n\n[ASSISTANT_RESPONSE]"


def test_json_is_all_of_the_text(spark):
    cases = {'{"a": 1}': True, " [1, 2] ": True, "12": True, '"x"': True, "null": True, "12 words after it": False, '"x" y': False, '{"a": 1} {"b": 2}': False, "1, 2": False, "1] [": False, '1, "': False, "": False}
    got = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string").select("c", text.is_json(F.col("c")).alias("ok")).collect()
    assert {r.c: r.ok for r in got} == cases | {None: False}
    assert one(spark, text.feedback(F.lit("8294846167456848 tell me more"))) == "8294846167456848 tell me more"


def test_swaps_draw_once_a_swap(spark):
    """The draw stands outside the pass over the words, and the words change places one after another."""
    texts = {k: " ".join(f"w{i}" for i in range(n)) for k, n in enumerate((0, 1, 2, 3, 4, 30))}
    col = noise.swaps(F.col("t"), F.col("k"), times=3)
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    rows = df.select("k", col.alias("x"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: rand.uniform("swap", F.col("k"), i)).alias("u")).collect()
    for r in rows:
        w = texts[r.k].split()
        for u in r.u[: min(3, len(w) // 2)]:
            i = min(int(u * (len(w) - 1)), len(w) - 2)
            w[i], w[i + 1] = w[i + 1], w[i]
        assert r.x == " ".join(w)
    assert df.select(col.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert one(spark, noise.swaps(F.lit(None).cast("string"), F.lit(1))) is None
