"""The n-gram Jaccard join against brute force, with and without the first grouping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import ngramjoin

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id bigint, text string, sid string, n int, component_id int"


def shingle_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x85", "_").replace("\xa0", "_").split()
    return set() if not w else {tuple(w)} if len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((-1 if i is None else i, len(sets[k]), -1 if i is None else least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(4)
    say = lambda n: rng.choice(WORDS, n).tolist()
    texts = [" ".join(say(80)) for _ in range(30)]
    shared = say(60)
    texts += [" ".join(shared + say(40 + 3 * k)) for k in range(30)]  # a passage in common, not alike
    texts += [" ".join(shared + say(6 + k % 3)) for k in range(12)]  # hardly more than the passage
    base = say(300)
    for k in range(60):  # a large group of near copies
        x = list(base)
        for at in rng.integers(0, 300, 1 + k % 4):
            x[at] = "zz"
        texts.append(" ".join(x))
    for k in range(60):  # pairs about the threshold, of several sizes
        x = say(20 + 4 * k)
        y = list(x)
        y[: k % 7] = say(k % 7)
        y[10] = "q" if k % 2 else y[10]
        texts += [" ".join(x), " ".join(y + say(k % 5))]
    chain = say(200)
    for k in range(8):  # each like the next, the ends unlike
        chain = chain[4:] + say(4)
        texts.append(" ".join(chain))
    texts += [None, "", " \n\t", "one", "ONE", "x y z", "X y  z", "a b c d", "a b c d a b c d", texts[0], texts[0].upper(), " ".join(say(30_000))]
    return list(enumerate(texts)) + [(None, texts[0]), (3, "another text of the same id is here"), (3, texts[40])]


@pytest.mark.parametrize("first", [True, False])
def test_same_classes_as_brute_force(spark, first, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(ngramjoin, "GROUP", 5)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 6)
    if not first:  # every link has to come through the matrix
        monkeypatch.setattr(ngramjoin, "linked", lambda rows: iter(()))
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], DOCS)
    got = ngramjoin.jaccard_classes(df.repartition(5)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)


def test_order_of_tokens_and_bounds():
    rng = np.random.default_rng(1)
    frequent = np.zeros(ngramjoin.FILTER_BITS // 8, np.uint8)
    s = np.unique(rng.integers(0, 1 << 63, 200, np.uint64))
    t = (s >> np.uint64(2)).view(np.int64)
    for k in (0, 5, 9):
        at = int(t[k]) & (ngramjoin.FILTER_BITS - 1)
        frequent[at // 8] |= np.uint8(1 << at % 8)
    want = [x for k, x in enumerate(t.tolist()) if k not in (0, 5, 9)][:31]
    assert ngramjoin.ordered(s, frequent).tolist() == want
    for n in range(1, 400):
        least = min(o for o in range(1, n + 1) if 100 * o >= 85 * n)
        assert ngramjoin.first_tokens(n) == n - least + 1


def test_empty_table_and_no_words(spark):
    assert not ngramjoin.jaccard_classes(spark.createDataFrame([], DOCS)).collect()
    got = ngramjoin.jaccard_classes(spark.createDataFrame([(1, None, "", 1, 1), (2, " ", "", 1, 1), (None, "a b", "", 1, 1)], DOCS)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id) == [(1, 0, 1), (2, 0, 2)]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 1, None)]


def test_first_tokens_are_shuffled_once_by_their_sets(spark, monkeypatch):
    """Telling sets that moved apart, distinct rows and the join by sid that follows share one exchange."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", 2)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [(i, f"{common} " + " ".join(f"w{i}x{k}" for k in range(4))) for i in range(12)] + [(50 + i, " ".join(f"v{i}x{k}" for k in range(20))) for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    marks = ngramjoin.checkpointed(ngramjoin.sketches(docs))
    reps = ngramjoin.checkpointed(marks.selectExpr("sid", "doc_id AS rep", "n_shingles AS n", "keys", "element_at(first, -1) AS last"))
    rows, ends = ngramjoin.shared_tokens(marks, reps, docs, "text", "doc_id")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r.sid, r.token) for r in rows.collect()}
    assert len(got) == rows.count() and ends.count() == len(texts)
    moved = {r.sid for r in marks.where("doc_id < 50").collect()}
    assert {s for s, t in got if t >= ngramjoin.LAST} <= moved and {s for s, _ in got} >= moved


def test_a_crowd_leaves_no_frequent_token_at_the_front(spark, monkeypatch):
    """All tokens of a text that many documents vary come last at once, however many of them follow each other to the front."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", 8)
    monkeypatch.setattr(ngramjoin, "SAMPLE", 2, raising=False)
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(100):
        x = list(base)
        for at in rng.integers(0, 150, 8):
            x[at] = f"own{i}x{at}"
        texts.append((i, " ".join(x)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    marks = ngramjoin.checkpointed(ngramjoin.sketches(docs))
    reps = ngramjoin.checkpointed(marks.selectExpr("sid", "doc_id AS rep", "n_shingles AS n", "keys", "element_at(first, -1) AS last"))
    rows, _ = ngramjoin.shared_tokens(marks, reps, docs, "text", "doc_id")
    first = rows.where(rows.token < ngramjoin.LAST).groupBy("token").count()
    assert first.where("count > 8").count() == 0


def first_rows(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    marks = ngramjoin.checkpointed(ngramjoin.sketches(docs))
    reps = ngramjoin.checkpointed(marks.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.max(F.element_at("first", -1)).alias("last")))
    return marks, ngramjoin.shared_tokens(marks, reps, docs, "text", "doc_id")[0]


def test_tokens_of_sets_that_moved_call_no_others_again(spark, monkeypatch):
    """Each set's first tokens leave once, in one order for all, whatever sets share a bit of the filter of tokens with it."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", 8)
    monkeypatch.setattr(ngramjoin, "SAMPLE", 2)
    common = " ".join(f"c{i}" for i in range(60))
    texts = [(i, f"{common} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(60)] + [(100 + i, " ".join(f"v{i}x{k}" for k in range(50))) for i in range(9)]
    marks, rows = first_rows(spark, texts + [(200, texts[0][1]), (201, texts[65][1])])
    got = rows.groupBy("sid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x")).collect()
    sizes = {r.sid: r.n_shingles for r in marks.collect()}
    assert {r.sid: r.n for r in got} == {sid: ngramjoin.first_tokens(n) for sid, n in sizes.items()}
    assert all(r.pos == list(range(r.n)) and (t := [x.token for x in r.x]) == sorted(t) for r in got)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan


def test_sets_with_a_key_in_common_by_chance_are_not_fetched(spark, monkeypatch):
    """Of a key's members only those whose histograms allow the similarity have their sets read for it."""
    rng = np.random.default_rng(3)
    say = lambda n: rng.choice([f"u{i}" for i in range(5000)], n).tolist()
    texts = [(i, " ".join(say(150))) for i in range(20)]
    x = say(150)
    texts += [(50, " ".join(x)), (51, " ".join([*x[:-2], "other", "end"]))]
    monkeypatch.setattr(ngramjoin, "minwise", lambda s, factors: np.zeros(len(factors), np.int32))  # all keys are the same
    seen = spark.sparkContext.accumulator(0)
    linked = ngramjoin.linked

    def counted(rows):
        seen.add(len(rows))
        return linked(rows)

    monkeypatch.setattr(ngramjoin, "linked", counted)
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_classes(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {i: 50 if i == 51 else i for i, _ in texts}
    assert seen.value == 2 * ngramjoin.KEYS


def test_histograms_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 300, 30_000):
        base = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        sets = [base, *(np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, np.uint64)])) for k in (0, n // 30, n // 15, n // 8, n // 2))]
        rows = [(i, len(s), ngramjoin.histogram(s), 7) for i, s in enumerate(sets)]
        similar = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and ngramjoin._similar(x, y)}
        assert similar <= {i for i, at in ngramjoin.alike(rows) if at == 7}
    assert not list(ngramjoin.alike([])) and not list(ngramjoin.alike([(1, 5, None, 7)]))
