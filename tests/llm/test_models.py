"""Language ID, toxicity and LM scoring: held-out accuracy, plain versions and odd inputs; the pipeline."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import langid, lm, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id bigint, text string, lang string, score int"
SYLLABLES = {"aa": "ka lo mi ne ru".split(), "bb": "sch tz pf ung ei".split(), "cc": "que ción ado ez ñ".split()}


def made(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


def test_languages(spark):
    rng = np.random.default_rng(0)
    rows = [(i, made(rng, lang := list(SYLLABLES)[i % 3]), lang, 0) for i in range(240)]
    odd = [(1000, None, "aa", 0), (1001, "", None, 0), (1002, "123 !? \U0001f600", "bb", 0), (1003, made(rng, "bb", 30_000), None, 0), (None, made(rng, "cc"), None, 0)]
    df = spark.createDataFrame(rows + odd, DOCS)
    model = langid.fit(df, ~langid.held_out())
    got = {r.doc_id: r for r in langid.languages(df, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows) >= 238
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())
    strange = spark.createDataFrame([(1, "ωψχφ υτσρ " * 20, "", 0)], DOCS)
    assert langid.languages(strange, model).first().rejected
    empty = df.limit(0)
    assert langid.languages(empty, model).count() == 0
    assert langid.languages(df, langid.fit(empty)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_toxicity_and_misspellings(spark):
    rng = np.random.default_rng(1)
    bad = ["fizzbad", "grumwort", "snarkle"]

    def doc(i):
        w = made(rng, "aa", 60).split()
        if i % 4 == 0:
            for at in rng.integers(0, 60, 3):
                w[at] = bad[rng.integers(3)]
        return " ".join(w)

    rows = [(i, doc(i), "aa", 0) for i in range(400)]
    odd = [(1000, None, "", 0), (1001, "", "", 0), (1002, "so fizzzbad", "", 0), (1003, made(rng, "aa", 20_000), "", 0), (1004, made(rng, "aa", 5000) + " grumwort " + made(rng, "aa", 5000), "", 0)]
    df = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, labels, ~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    wrong = [i for i in range(400) if got[i].predicted != (i % 4 == 0)]
    assert len(wrong) <= 8
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert got[1000].predicted == got[1001].predicted == got[1003].predicted == 0
    assert got[1002].predicted == 1 and got[1004].predicted == 1
    none = labels.limit(0)
    assert toxicity.toxicity(df, toxicity.fit(df, none)).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity(df.limit(0), model).count() == 0


def targets(v, x):
    return v.cls[x].astype(np.int64), v.slot[x].astype(np.int64)


@pytest.mark.parametrize("share", [0.0001, 0.01])
def test_lm_is_a_distribution(share):
    """Over all tokens, whatever stands around; with fewer tokens than outputs and with more."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, lm.TOKENS) * (rng.random(lm.TOKENS) < share)
    v = lm.Vocabulary.of(counts)
    assert (lm.frequent_of(v) == lm.frequent(counts)).all()
    again = lm.Vocabulary.ranked(lm.frequent_of(v))
    assert (again.cls == v.cls).all() and (again.slot == v.slot).all() and (again.inp == v.inp).all()
    net = lm.Network()
    around = rng.integers(0, lm.INPUTS, (4, 1))
    h = net.hidden(around)[0].astype(float)
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    first = soft(h @ net.w + net.c)
    second = np.stack([soft(h @ net.w2[g] + net.c2[g]) for g in range(lm.GROUPS)])
    p = first[v.cls] * np.where(v.slot < 0, 1, second[np.maximum(v.cls - lm.OWN, 0), v.slot]) * np.exp(v.log_rest.astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-3)
    some = rng.integers(0, lm.TOKENS, 50)
    got = net.log_outputs(np.tile(around, (1, 50)), *targets(v, some)) + v.log_rest[some]
    assert got == pytest.approx(np.log(p[some]), abs=1e-3)


def test_token_ids_are_the_words():
    texts = ["The cat  the\tCAT.\n", None, "", " \n", "é É ß\x1f\xa0x", "the cat", "a" * 3_000_000 + " the", "the " * 300_000]
    got = lm.token_ids(texts)
    names: dict[str, int] = {}
    for t, x in zip(texts, got, strict=True):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
        assert len(words) == len(x)
        assert all(names.setdefault(w, i) == i for w, i in zip(words[:500], x[:500].tolist(), strict=True))
    assert len(set(names.values())) == len(names) == 7
    assert [lm.token_ids([t])[0].tolist() for t in texts] == [x.tolist() for x in got]


def test_lm_scores(spark):
    rng = np.random.default_rng(0)
    line = made(rng, "aa", 12)
    rows = [(i, " ".join([line] * 40), "", 0) for i in range(60)] + [(100, None, "", 0), (101, "", "", 0), (102, " ".join(rng.permutation(line.split()).tolist() * 40), "", 0), (102, "ka", "", 0), (None, line, "", 0), (103, line * 5000, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, shard int")
    got = lm.score(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and (by[100].n_tokens, by[100].log_prob, by[101].log_prob) == (0, 0.0, 0.0)
    assert by[0].log_prob < 0 and by[0].n_tokens == 480 and by[0].mean_log_prob == pytest.approx(by[0].log_prob / 480)
    assert by[1].log_prob == pytest.approx(by[0].log_prob, rel=1e-5) and by[None].n_tokens == 12
    assert lm.score(df.limit(0)).count() == 0


def test_lm_does_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_ROWS", 40)
    rng = np.random.default_rng(7)
    rows = [(i, made(rng, "aa", 60), "", 0) for i in range(150)]
    rows += rows[:5] * 20  # repeated rows count each time and are trained on once
    df = spark.createDataFrame(rows, DOCS)
    a, b = ({r.doc_id: r.log_prob for r in lm.score(df.repartition(n)).collect()} for n in (1, 7))
    assert a == pytest.approx(b, rel=1e-4)


def test_lm_learns_and_sums_plainly():
    rng = np.random.default_rng(0)
    text = " ".join([made(rng, "aa", 12)] * 50)
    x = lm.token_ids([text])[0]
    v = lm.Vocabulary.of(np.bincount(x, minlength=lm.TOKENS))
    net = lm.Network()
    before = lm.log_probs([x, x[:0], x[:7]], net, v)
    plain = 0.0
    for t in range(len(x)):
        around = np.array([[v.inp[x[t + k]] if 0 <= t + k < len(x) else lm.PAD] for k in lm.AROUND])
        h = net.hidden(around)[0]
        z = h @ net.w + net.c
        plain += z[v.cls[x[t]]] - math.log(np.exp(z).sum()) + v.log_rest[x[t]]
        if v.slot[x[t]] >= 0:
            g = v.cls[x[t]] - lm.OWN
            z = h @ net.w2[g] + net.c2[g]
            plain += z[v.slot[x[t]]] - math.log(np.exp(z).sum())
    assert before[0] == pytest.approx(plain, rel=1e-4) and before[1] == 0 and 0 > before[2] > plain
    line, places = lm.lay([x], v.inp)
    for _ in range(60):
        net.step(np.stack([line[places + k] for k in lm.AROUND]), *targets(v, x), lm.RATE)
    assert lm.log_probs([x], net, v)[0] > before[0] + 50


def test_one_step_follows_the_slope():
    """The slopes of every weight against differences of the mean log-probability."""
    rng = np.random.default_rng(1)
    n = 300
    cls, slot = rng.integers(0, lm.CLASSES, n), rng.integers(0, lm.MEMBERS, n)
    around = rng.integers(0, 40, (4, n))
    net = lm.Network()
    start, moved = net.flat.copy(), lm.Network(net.flat.copy())
    moved.step(around, cls, slot, 1.0)
    # Adagrad's first step is the slope over its own size: only signs are left, where the slope is not tiny
    loss = lambda flat: -lm.Network(flat).log_outputs(around, cls, slot).astype(float).mean()
    tried = right = 0
    for at in rng.choice(np.flatnonzero(np.abs(moved.flat - start) > 0.9), 60, replace=False):
        up, down = start.copy(), start.copy()
        up[at] += 0.02
        down[at] -= 0.02
        slope = (loss(up) - loss(down)) / 0.04
        if abs(slope) > 1e-4:
            tried += 1
            right += np.sign(slope) == np.sign(start[at] - moved.flat[at])
    assert tried > 20 and right == tried


def test_lm_beats_counts_alone():
    """On texts with an order, places left out of training are likelier under the network than under their counts."""
    rng = np.random.default_rng(3)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(3)] for i in range(60)}

    def walk(n):
        w = ["w0"]
        while len(w) < n:
            w.append(follow[w[-1]][rng.integers(3)])
        return " ".join(w)

    ids = lm.token_ids([walk(300) for _ in range(60)])
    counts = np.bincount(np.concatenate(ids[:50]), minlength=lm.TOKENS)
    v, net = lm.Vocabulary.of(counts), lm.Network()
    line, places = lm.lay(ids[:50], v.inp)
    x = np.concatenate(ids[:50])
    for _ in range(8):
        for at in range(0, len(places), 500):
            p = places[at : at + 500]
            net.step(np.stack([line[p + k] for k in lm.AROUND]), *targets(v, x[at : at + 500]), lm.RATE)
    unigram = np.log((counts + lm.ALPHA) / (counts + lm.ALPHA).sum())
    assert lm.log_probs(ids[50:], net, v).sum() > sum(unigram[t].sum() for t in ids[50:]) + 0.5 * sum(map(len, ids[50:]))


@tables
def test_held_out_accuracy(spark):
    from dialoom.llm import queries

    lang = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        left = {r.doc_id for r in out.collect()}
        assert left <= ids and out.count() == len(left)
        ids, docs = left, out
    packed = p.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == ids and ids


def test_languages_against_a_plain_nearest_centroid(spark):
    rng = np.random.default_rng(5)
    rows = [(i, made(rng, list(SYLLABLES)[i % 3], 8 + i % 9), list(SYLLABLES)[i % 3], 0) for i in range(90)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    texts = [t for _, t, _, _ in rows[:12]] + ["ka ka ka", "schtz 12 über"]
    names, scores, _ = model.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        v = np.array([math.log1p(n) for n in langid.gram_counts(t)]) * model.idf
        cos = [float(v @ c) / (math.sqrt(v @ v) * math.sqrt(c @ c)) for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert name == model.langs[best] and score == pytest.approx(cos[best], abs=1e-5)
    counts = langid.gram_counts("abc")
    assert counts.sum() == 5 + 4 + 3  # " abc " has so many runs of one, two and three characters


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 90)
    rng = np.random.default_rng(6)
    rows = [(i, made(rng, "aa"), "aa", 0) for i in range(1500)] + [(5000 + i, made(rng, "bb"), "bb", 0) for i in range(25)]
    rows += [(7, "ka lo", "bb", 0)] * 5 + [(9000, made(rng, "cc"), "cc", 0)]  # repeated ids, a language of one row
    df = spark.createDataFrame(rows, DOCS)
    chosen = langid.sampled(df.select(F.col("doc_id").alias("id"), "lang"))
    assert {r.lang: r["count"] for r in chosen.groupBy("lang").count().collect()} == {"aa": 30, "bb": 26, "cc": 1}
    model = langid.fit(df)
    assert set(model.langs) == {"aa", "bb", "cc"}
    names, _, _ = model.predict([made(rng, lang) for lang in ("bb", "cc", "aa")])
    assert names == ["bb", "cc", "aa"]
    clash = df.withColumn("x", F.lit(1)).withColumn("id", F.lit("a")).withColumn("score", F.lit("b"))
    assert langid.languages(clash, langid.fit(clash)).count() == len(rows)


def test_equally_near_languages_take_the_first_in_order():
    v = np.zeros((2, langid.BUCKETS))
    v[:, 5] = 1
    model = langid.Model(np.ones(langid.BUCKETS), v, ["bb", "cc"], {"bb": 0.0, "cc": 0.0})
    assert model.predict(["ka lo"])[0] == ["bb"]


def test_toxicity_against_plain_bags():
    """Window logits and one training step against sums over every n-gram."""
    rng = np.random.default_rng(2)
    docs = [made(rng, "aa", n).split() for n in (5, 30, 12)]
    bags, model = toxicity.Bags(docs), toxicity.Model()
    bucket = {w: toxicity.grams([w])[1].tolist() for d in docs for w in d}
    w = model.weights()
    sums, counts = np.add.reduceat(w[bags.flat], bags.start[:-1]), np.diff(bags.start)
    for d, idx in zip(docs, bags.docs, strict=True):
        assert [bags.flat[bags.start[i] : bags.start[i + 1]].tolist() for i in idx] == [bucket[x] for x in d]
        plain, at = [], 0
        while at < max(len(d) - toxicity.WINDOW, 0) + toxicity.STRIDE:
            total = n = 0
            for k in range(at, min(at + toxicity.WINDOW, len(d))):
                n += len(bucket[d[k]])
                if d[k] not in d[max(0, k - toxicity.WINDOW + 1) : k]:
                    total += sum(w[b] for b in bucket[d[k]])
            plain.append(total / max(n, toxicity.LEAST_BAG))
            at += toxicity.STRIDE
        assert toxicity.logits(sums, counts, idx) == pytest.approx(plain, abs=1e-6)
    y = np.array([1, 0, 1])
    size = np.array([70.0, 500.0, 90.0], np.float32)
    rows = [np.unique(i) for i in bags.docs]
    e, v, b = model.e.astype(float), model.v.astype(float), model.b.astype(float)
    ge, gv, gb = np.zeros_like(e), np.zeros_like(v), np.zeros(2)
    for r, n, t in zip(rows, size, y, strict=True):
        owned = [k for i in r for k in bags.flat[bags.start[i] : bags.start[i + 1]]]
        mean = sum(e[k] for k in owned) / n
        z = v @ mean + b
        d = np.exp(z) / np.exp(z).sum() - np.eye(2)[t]
        d /= len(y)
        gv += np.outer(d, mean)
        gb += d
        for k in owned:
            ge[k] += v.T @ d / n
    model.step(bags, rows, size, y, 0.3)
    assert model.e == pytest.approx(e - 0.3 * ge / np.sqrt(1e-6 + ge**2), abs=1e-4)
    assert model.v == pytest.approx(v - 0.3 * gv / np.sqrt(1e-6 + gv**2), abs=1e-4)
    assert model.b == pytest.approx(b - 0.1 * gb, abs=1e-6)


def test_toxicity_of_repeated_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 4000)
    rng = np.random.default_rng(4)
    rows = [(i % 50, made(rng, "aa", 12) + (" grumwort fizzbad" if i % 50 % 2 else ""), 1.0, "y", 7) for i in range(200)] + [(None, "grumwort", 1.0, "y", 7), (60, made(rng, "aa", 20_000), 1.0, "y", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double, y string, n int")
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(61)] * 2, "doc_id bigint, toxic int, id string")
    got = toxicity.toxicity(df, toxicity.fit(df, labels)).collect()
    assert len(got) == len(rows) and sum(r.predicted == 1 for r in got if r.doc_id is not None and r.doc_id < 50) == 100


def test_one_softmax_for_all_groups(monkeypatch):
    """A step and a score take two softmaxes, however many groups occur, and give what each group alone gives."""
    rng = np.random.default_rng(1)
    n = 500
    around = rng.integers(0, lm.INPUTS + 1, (len(lm.AROUND), n))
    cls = rng.integers(0, lm.CLASSES, n)
    slot = np.where(cls < lm.OWN, -1, rng.integers(0, lm.MEMBERS, n))
    net, calls = lm.Network(), []
    h = net.hidden(around)
    z = h @ net.w + net.c
    want = z[np.arange(n), cls] - np.log(np.exp(z).sum(1))
    for g in range(lm.GROUPS):
        rows = cls == lm.OWN + g
        z = h[rows] @ net.w2[g] + net.c2[g]
        want[rows] += z[np.arange(len(z)), slot[rows]] - np.log(np.exp(z).sum(1))
    for name in ("_log_softmax", "_error"):
        f = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, f=f, name=name: calls.append(name) or f(*a))
    assert net.log_outputs(around, cls, slot) == pytest.approx(want, abs=1e-5)
    net.step(around, cls, slot, 0.1)
    assert calls == ["_log_softmax"] * 2 + ["_error"] * 2
    few = cls < lm.OWN
    net.step(around[:, few], cls[few], slot[few], 0.1)
    assert np.isfinite(net.log_outputs(around[:, few], cls[few], slot[few])).all()
