"""Queries without an oracle against plain-Python replays over the smallest tables, and linear noise against the folds."""

import hashlib
import json
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from dialoom.functions import noise
from dialoom.operators import noising
from dialoom.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SPACE = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name, key):
    got = catalog.queries()[name](spark, SF).collect()
    out = {tuple(r[k] for k in key) if isinstance(key, tuple) else r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def uniform(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 1) / 4294967297


def generate(prompt, empty_every=0):
    """The mock client's answer, stated again."""
    h = zlib.crc32(prompt.encode())
    if empty_every and h % empty_every == 0:
        return ""
    if prompt.startswith("FEEDBACK"):
        return json.dumps({"satisfied": h % 4 == 0, "feedback": f"please say more about point {h % 97}"})
    if prompt.startswith("JUDGE 1-5"):
        return f"Score: {h % 5 + 1} of 5"
    if prompt.startswith("JUDGE"):
        return f"Score: {h % 10 + 1}"
    return f"answer {h % 10_007}"


@pytest.mark.parametrize(("name", "fold"), [("typo", noise.typos), ("word_deletion", noise.deletions), ("word_insertion", noise.insertions), ("synonym", noise.synonyms)])
def test_linear_noise_is_the_fold(spark, name, fold):
    texts = [None, "", " \n", "a", "Big", "it's Big, really GOOD help!", "  ünï Çode\tfast  slow. ", "x y z " * 30, "Make the small show get help fast " * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    want = {r.k: r.n for r in df.select("k", fold(F.col("t"), F.col("k")).alias("n")).collect()}
    got = {r.k: r.noisy for r in noising.noisy(df, "k", "t", name).collect()}
    assert got == want


def test_linear_noise_of_a_long_text():
    text = "Make the small show get help fast " * 20_000
    for f in noising.STRATEGIES.values():
        assert abs(len(f(text, 1)) - len(text)) < len(text) / 2


@tables
def test_word_swaps(spark, docs):
    got = run(spark, "t21_word_swaps", "doc_id")
    for i, t in docs.items():
        bit = t.replace("\n", " ")
        w = re.split(r"[ \t\n\x0b\f\r]+", bit.strip(SPACE)) if bit.strip(SPACE) else []
        for k in range(1, min(2, len(w) // 2) + 1):
            p = min(int(uniform("swap", i, k) * (len(w) - 1)), len(w) - 2)
            w[p], w[p + 1] = w[p + 1], w[p]
        assert got[i].noisy == (bit if len(w) < 2 else " ".join(w))


@tables
def test_answers(spark, docs):
    para, judged, best = (run(spark, n, "doc_id") for n in ("t25_paraphrases", "c09_judged_rollouts", "c10_optimise_with_fallback"))
    for i, t in docs.items():
        q = t.replace("\n", " ")
        assert para[i].noisy == (generate(f"PARAPHRASE\n{q}", 7) or q)
        said = generate(f"JUDGE 1-5\n{q}", 9)
        score = (int(said.split()[1]) - 1) / 4 if said else None
        assert (judged[i].total, judged[i].failed) == ((0.0, True) if score is None else (pytest.approx(0.3 * score + 0.7, abs=1e-6), False))
        said = generate(f"OPTIMISE\n{q}", 5)
        assert (best[i].optimized_prompt, best[i].fell_back) == (said or q, not said)


@tables
def test_dialogues(spark, docs):
    got = run(spark, "c01_dialogues", "task_id")
    for i, t in docs.items():
        messages, turn, target = [("User", t)], 0, 2 + i % 3
        while turn < 5:
            lines = "\n".join(f"{r}: {c}" for r, c in messages)
            answer = generate(f"REPLY\n{lines}")
            turn += 1
            messages.append(("Assistant", answer))
            if turn >= target:
                break
            said = json.loads(generate(f"FEEDBACK {turn}/{target}\n- tone: brief\n{lines}\n{answer}"))
            if said["satisfied"]:
                break
            messages.append(("User", said["feedback"]))
        assert (got[i].n_messages, got[i].num_turns, got[i].attempts) == (len(messages), sum(r == "User" for r, _ in messages), 1)


@tables
def test_noised_texts(spark, docs):
    got = run(spark, "t27_noised_texts", "doc_id")
    layers = {0: ("skipped",), 1: ("surface_noise",), 2: ("incomplete_info",), 3: ("semantic_ambiguity",)}
    table = [("casual", True, 0.0), ("fragment", False, 0.3), ("misspelt", False, 0.25), ("spacing", False, 0.15), ("stops", False, 0.4)]
    asked = 0
    for i, t in docs.items():
        r = got[i]
        u = uniform("t27/layer", i)
        want = 0 if uniform("t27/active", i) > 0.7 else 1 if u < 0.5 else 2 if u < 0.8 else 3
        assert (r.text, r.layer_index, r.layer) == (t, want, layers[want][0])
        names = [n for n, must, p in table if must or uniform("t27/strategy", i, n) < p] if want else []
        assert sorted(r.strategies) == sorted(names)
        assert r.noisy_text == t if not want else re.fullmatch(r"answer \d+", r.noisy_text)
        asked += want > 0
    assert asked > 50


@tables
def test_style(spark, docs):
    got = run(spark, "t28_style_transfer", "doc_id")
    known = 0
    for i, t in docs.items():
        template = "partial" if uniform("t28", i) < 0.5 else "full"
        prompt = f"STYLE {template}\n- tone: brief\n{t}"
        h = zlib.crc32(prompt.encode())
        r = got[i]
        assert (r.original_query, r.prompt_type) == (t, template)
        assert r.adapted_query == f"quick one: {t.rsplit(chr(10), 1)[-1]}"
        assert r.inferred_scenario in ("others", ("casual", "learning")[h % 2]) and r.inferred_domain in ("others", ("coding", "travel", "gardening")[h % 3])
        known += r.inferred_domain != "others"
    assert known


@tables
def test_scored_evaluation(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}

    def scores(q):
        said = generate(f"ANSWER\n{q}")[:2000]
        return [int(generate(f"JUDGE {w}\n{said}").split()[1]) for w in ("persona", "task")]

    base = {i: scores(t) for i, t in items.items()}
    got = {r.checkpoint: r.asDict() for r in catalog.queries()["c12_scored_evaluation"](spark, SF).collect()}
    assert set(got) == {0, 1}  # checkpoint 2 has failed
    mean = lambda v: sum(v) / len(v)
    for c, r in got.items():
        new = {i: scores(f"{t} v{c}") for i, t in items.items()}
        want = [mean([x[k] for x in new.values()]) for k in (0, 1)] + [mean([new[i][k] - base[i][k] for i in items]) for k in (0, 1)]
        assert r["n"] == len(items) and [r["persona"], r["task"], r["persona_delta"], r["task_delta"]] == pytest.approx(want)


@tables
def test_persona_prompts(spark):
    made = run(spark, "t29_persona_prompts", "persona_id")
    assert len(made) == 200 and all(re.fullmatch(r"answer \d+", r.system_prompt) for r in made.values())
    batch = catalog.queries()["c05b_persona_batch"](spark, SF).collect()
    assert 80 < len(batch) < 200 and all(r.num_features == 15 and re.fullmatch(r"persona_[0-9a-f]{12}", r.persona_key) for r in batch)


@tables
def test_diverse_personas_are_apart(spark):
    rows = catalog.queries()["r08_diverse_personas"](spark, SF).collect()
    assert rows and len({repr(r) for r in rows}) == len(rows)
