"""Near-dedup and decontamination against brute force, with odd inputs."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import components, decontam, neardup

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id bigint, text string, lang string, a int"


def shingle_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):  # unrelated
        texts.append(" ".join(rng.choice(WORDS, 80)))
    shared = " ".join(rng.choice(WORDS, 60))
    for _ in range(40):  # a passage in common, not alike
        texts.append(shared + " " + " ".join(rng.choice(WORDS, 120)))
    base = rng.choice(WORDS, 300)
    for k in range(120):  # a large group of near copies
        x = base.copy()
        x[rng.integers(0, 300, 1 + k % 4)] = "zz"
        texts.append(" ".join(x))
    for k in range(60):  # pairs about the threshold
        x = rng.choice(WORDS, 100)
        y = x.copy()
        y[: 3 + k % 4] = rng.choice(WORDS, 3 + k % 4)
        y[50] = "q"
        texts += [" ".join(x), " ".join(y)]
    chain = rng.choice(WORDS, 200)
    for k in range(8):  # each like the next, the ends unlike
        chain = chain.copy()
        chain[k * 20 : k * 20 + 16] = rng.choice(WORDS, 16)
        texts.append(" ".join(chain))
    texts += ["exact copy"] * 5 + ["Exact COPY", "a b c d", "a b c d e", None, "", " \n", " ".join(rng.choice(WORDS, 20_000))]
    return list(enumerate(texts))


def test_near_duplicates(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x", 1), (3, "a b c d e f", "x", 1), (3, "a b c d e f", "x", 1)], DOCS)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hubs", [True, False])
def test_copies_alike_to_one_original_only(spark, monkeypatch, hubs):
    rng = np.random.default_rng(8)
    base, copies = rng.choice(WORDS, 300), 150
    rows = []
    for k in range(copies):
        x = base.copy()
        x[(rng.permutation(37)[:7] * 8 + 2)] = [f"e{k}_{i}" for i in range(7)]
        rows.append((k if k < copies // 2 else k + 1, " ".join(x)))
    rows.append((copies // 2, " ".join(base)))
    if not hubs:  # all is left to the exact comparison
        monkeypatch.setattr(neardup, "hub_pairs", lambda wide, reps: wide.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
        monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()} and set(got.values()) == {0}


@pytest.mark.parametrize("n", [2, 40])
def test_components(spark, n):
    path = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 60)] + [(500, 500 - 1), (499, 498), (7, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(path, "u bigint, v bigint").repartition(7)).collect()}
    want = {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, 60)} | {500: 498, 499: 498}
    assert {k: v for k, v in got.items() if k not in (5, 7)} == {k: v for k, v in want.items() if k not in (5, 7)}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_contamination(spark):
    rng = np.random.default_rng(2)
    items = [" ".join(rng.choice(WORDS, n)) for n in (15, 40, 57, 7)] + ["two words", None, ""]
    clean = [" ".join(rng.choice(WORDS, 300)) for _ in range(30)]

    def with_item(k, subs=0):
        w = items[k].split()
        for at in np.linspace(3, len(w) - 4, subs).astype(int):
            w[at] = "other"
        return f"{clean[0]} {' '.join(w).upper()}, {clean[1]}"

    texts = [with_item(0), with_item(1, 3), with_item(2, 5), with_item(3), f"{items[1]} {items[2]}", items[1] * 1, "two words", None, "", items[0].rsplit(" ", 1)[0] + "."]
    half = " ".join(items[2].split()[:9])
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts + clean + [half])], DOCS)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 1), (4, 2), (5, 1), (9, 0)}
    assert (got[1, 1].n_equal, got[1, 1].n_span) == (37, 40) and got[0, 0].doc_start == 300
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts) + 31)) - {0, 1, 2, 3, 4, 5, 9}
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    item = " ".join(rng.choice(WORDS, 30))
    docs = spark.createDataFrame([(1, f"x {item} y", "", 1), (2, " ".join(rng.choice(WORDS, 50)), "", 1)], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    want = decontam.contamination(docs, bench).collect()
    monkeypatch.setattr(decontam, "seed_filter", lambda seeded: (np.full(decontam.FILTER_BITS // 8, 255, np.uint8), None))
    assert decontam.contamination(docs, bench).collect() == want and len(want) == 1


def test_substitutions_at_every_place(spark):
    rng = np.random.default_rng(9)
    items = {n: rng.permutation(WORDS)[:n] for n in (*range(5, 17), 40)}
    rows, want = [], set()

    def add(n, passage, at, found):
        x = passage.copy()
        x[list(at)] = "zz"
        rows.append((len(rows), " ".join(["before it", *x, "and after it"]), "", 1))
        if found:
            want.add((len(rows) - 1, n))

    for n in range(5, 17):
        for at in combinations(range(n), n // 5):
            add(n, items[n], at, True)
            add(40, items[40][11 : 11 + n], at, n >= 13)
    for at in combinations(range(13), 3):
        add(40, items[40][5:18], at, False)
    for length, subs in ((20, 4), (25, 5), (30, 6)):
        for _ in range(40):
            add(40, items[40][3 : 3 + length], rng.permutation(length)[:subs], True)
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert not want - got
    own = {(i, 40) for i, t, _, _ in rows if set(t.split()) & set(items[40])}
    assert (got & own) - want == set()


@pytest.mark.parametrize("full", [0.5, 1.0])
def test_false_hits_hide_no_passage(spark, monkeypatch, full):
    rng = np.random.default_rng(5)
    words = rng.permutation(WORDS)[:60]
    rows, bench = [], spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    for k in range(120):
        x = words[k % 47 : k % 47 + 13 + 7 * (k % 2)].copy()
        if k % 2:
            x[[4, 13]] = "zz"
        rows.append((k, " ".join([*[f"f{k}_{i}" for i in range(k)], *x, *[f"g{k}_{i}" for i in range(20)]]), "", 1))
    sized = decontam.seed_filter

    def noisy(seeded):
        bits = sized(seeded)[0]
        return bits | np.packbits(np.random.default_rng(6).random(8 * len(bits)) < full), None

    monkeypatch.setattr(decontam, "seed_filter", noisy)
    assert {r.doc_id for r in decontam.contamination(spark.createDataFrame(rows, DOCS), bench).collect()} == set(range(120))


def test_the_filter_grows_with_the_seeds(spark, monkeypatch):
    monkeypatch.setattr(decontam, "EXACT_HASHES", 1000)
    seeded = spark.range(600_000).select(F.xxhash64("id").alias("seed"))
    bits, exact = decontam.seed_filter(seeded)
    assert exact is None and 600_000 * 0.9 < np.unpackbits(bits).sum() < 0.1 * 8 * len(bits)


def crowd(pair_own, others=200):
    """Pairs above the threshold among documents just below it: all share one long passage."""
    rng = np.random.default_rng(12)
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for k in range(others):
        own = [f"o{k}_{i}" for i in range(52)]
        for half in range(2):
            rows.append((2 * k + half, " ".join([*shared, *own[: 52 - pair_own], *[f"h{k}_{half}_{i}" for i in range(pair_own)]])))
    order = rng.permutation(len(rows))
    return [(int(order[i]), t) for i, t in rows]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_links_in_a_crowded_node(spark, partitions):
    rows = crowd(45)
    want = brute_components(rows)
    n_links = len({c for _, c in want.values()})
    assert n_links == len(rows) // 2  # only the pairs are linked
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: c for i, (_, c) in want.items()}


def test_a_repeated_id_with_unlike_texts(spark):
    rng = np.random.default_rng(3)
    x, y = rng.choice(WORDS, 200), rng.choice(WORDS, 200)
    near = y.copy()
    near[100] = "zz"
    rows = [(1, " ".join(x)), (1, " ".join(y)), (2, " ".join(near)), (3, " ".join(x)), (3, "only here at all")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 3)]
    assert sorted(r.text for r in neardup.keep_one(df).collect()) == sorted(t for i, t in rows if i != 2)


def test_trees_follow_from_the_recall():
    for recall in (0.5, 0.9, 0.99, 0.9998):
        t = neardup.trees_for(recall)
        assert 1 - (1 - 0.75**neardup.WIDE) ** t >= recall > 1 - (1 - 0.75**neardup.WIDE) ** (t - 1)


def plain_overlap(doc, item, d):
    """The stated stretch by trying every start and end on a diagonal: its equal tokens, length and start."""
    at = range(max(0, -d), min(len(item), len(doc) - d))
    same = [item[k] == doc[k + d] for k in at]
    e = np.concatenate([[0], np.cumsum(same)])
    spans = [(i, j, int(e[j] - e[i])) for i in range(len(e)) for j in range(i, len(e))]
    value = lambda i, j, n: n - 2 * (j - i - n)
    most = max(value(*x) for x in spans)
    best = [x for x in spans if value(*x) == most]
    ok = [x for x in spans if decontam.contaminated(x[2], x[1] - x[0], len(item)) and x[1] > x[0]]
    if any(x in ok for x in best):
        return {(n, j - i) for i, j, n in best}
    n = max((x[2] for x in ok), default=None)
    return {(n, min(x[1] - x[0] for x in ok if x[2] == n))} if ok else set()


@pytest.mark.parametrize("seed", range(30))
def test_overlap_against_all_stretches(seed):
    rng = np.random.default_rng(seed)
    item = np.arange(int(rng.integers(5, 40)))
    doc = np.concatenate([rng.integers(100, 200, 5), item, rng.integers(100, 200, 5)])
    doc[rng.random(len(doc)) < rng.uniform(0.05, 0.35)] = 99
    for d in (5, 4, -2, 20):
        q = max(0, -d) + 1
        if q + d >= len(doc) or q >= len(item):  # no hit there
            continue
        equal, length, x, y = decontam.overlap(doc, item, q + d, q)
        want = plain_overlap(doc.tolist(), item.tolist(), d)
        assert decontam.contaminated(equal, length, len(item)) == bool(want)
        assert not want or (equal, length) in want
        assert not want or (x - y == d and int((doc[x : x + length] == item[y : y + length]).sum()) == equal)


def test_items_that_overlap_and_long_spans(spark):
    rng = np.random.default_rng(6)
    line = [f"v{i}" for i in rng.permutation(5000)]
    items = [(1, " ".join(line[101:114])), (2, " ".join(line[100:160])), (3, " ".join(line[1000:1400])), (4, " ".join(line[1000:1400])), (5, " ".join(line[2000:2100]))]
    swapped = line[1000:1400]
    swapped[30:380:50] = ["zz"] * 7
    fill = lambda n: [f"f{i}" for i in rng.integers(0, 10**9, n)]
    texts = [
        (0, " ".join(fill(20) + line[100:160] + fill(9))),
        (1, " ".join(fill(300) + swapped + fill(30))),
        (2, " ".join(fill(20_000) + line[2000:2030] + fill(5) + line[2060:2100])),
        (2, "the same id with another text " + " ".join(line[2000:2080])),
        (3, " ".join(line[1100:1300])),
        (3, " ".join(line[1100:1300])),
        (None, "no id " + " ".join(line[1000:1200])),
        (None, "no id, clean"),
        (None, None),
        (4, "clean"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_span, r.doc_start, r.item_start) for r in decontam.contamination(docs, bench).collect()}
    assert got == {
        (0, 1): (13, 13, 21, 0),
        (0, 2): (60, 60, 20, 0),
        (1, 3): (393, 400, 300, 0),
        (1, 4): (393, 400, 300, 0),
        (2, 5): (80, 80, 6, 0),
        (3, 3): (200, 200, 0, 100),
        (3, 4): (200, 200, 0, 100),
        (None, 3): (200, 200, 2, 0),
        (None, 4): (200, 200, 2, 0),
    }
    left = decontam.clean(docs.withColumn("i", F.lit(1)).withColumn("h", F.lit("clash")), bench)
    assert left.columns == [*docs.columns, "i", "h"]
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (-1, "no id, clean"), (4, "clean")]


@pytest.mark.parametrize("links", [1 << 17, 20])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, links):
    """Few links take one task and no shuffle after their own; more go on in rounds to the same components."""
    monkeypatch.setattr(components, "LINKS", links)
    path = [(i, i + 1) for i in range(99)] + [(200, 201), (203, 201)]
    out = components.components(spark.createDataFrame(path, "u bigint, v bigint").repartition(7))
    assert {r.id: r.component for r in out.collect()} == {i: 0 for i in range(1, 100)} | {201: 200, 203: 200}
    assert (out.rdd.getNumPartitions() == 1) or links == 20
