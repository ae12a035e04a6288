"""The pipeline against plain versions of its stages, on a small table with every odd row."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pair_operators import brute_components, plain_overlap
from test_text_operators import plain_stats

import corpus_pipeline
from dialoom.llm import decontam, packing, quality
from dialoom.llm.common import WordHashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, line_dedup string, i int, `odd.name` string, kept boolean"
COMMON = "A line that stands in very many of the documents here"


def rows():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "sta", "mo", "lu")]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage = prose(30)
    texts = [(k, f"{prose(40)}\n{prose(30)}") for k in range(60)]
    texts += [(100 + k, f"{prose(60)}\n{COMMON}\n{prose(30)}") for k in range(6)]
    texts += [(200 + k, f"{prose(30)} {passage} {prose(30)}") for k in range(3)]
    base = prose(120).split()
    for k in range(5):  # near copies
        x = list(base)
        x[10 * k] = "changed"
        texts.append((300 + k, " ".join(x)))
    texts += [(400 + k, " ".join(f"{w}###" for w in prose(40).split())) for k in range(20)]
    texts += [(500, None), (501, ""), (502, " \n\t"), (503, "too few words"), (504, prose(20_000)), (505, "x" * 5000 + " " + prose(40))]
    texts += [(None, prose(50)), (None, f"{prose(30)} {passage}"), (None, None)]
    texts += [texts[3], texts[3], (7, prose(50))]  # repeated rows, and an id with unlike texts
    return texts, [(1, passage), (2, "short one"), (3, None), (None, prose(20))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    texts, items = rows()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, "o", True) for i, t in texts], SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60, 2)] + [(400 + k, 0, 0) for k in range(0, 20, 2)] + [(k, 1, 0) for k in (0, 100)] + [(None, 0, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, items


def lines_gone(texts):
    """The plain rule for each row; documents of one id count once, and rows without an id neither hold nor lose a line."""
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [(i, t if i is None or t is None else "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i)) for i, t in texts]


def contaminated(text, items):
    doc = decontam.tokens(text).tolist()
    for _, t in items:
        item = decontam.tokens(t).tolist()
        if any(plain_overlap(doc, item, d) for d in range(-len(item) + 1, len(doc)) if sum(doc[k + d] == x for k, x in enumerate(item) if 0 <= k + d < len(doc)) >= 4):
            return True
    return False


def test_every_stage_against_a_plain_version(spark, tables):
    at, texts, items = tables
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, now = docs.columns, texts

    def stage(k):
        nonlocal docs
        docs = corpus_pipeline.STAGES[k][1](spark, docs, at)
        assert docs.columns == columns
        got = docs.collect()
        assert all((r.lang, r.source, r.line_dedup, r.i, r["odd.name"], r.kept) == ("en", "s", "clash", 1, "o", True) for r in got)
        assert all(r.n_chars == len(r.text or "") for r in got)
        return order((r.doc_id, r.text) for r in got)

    forest, threshold = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))

    def good(t):
        s, ratios = quality.rule_stats(t, WordHashes())
        assert s == plain_stats(t)
        paths = []
        for feature, cut, child, path in forest.trees:
            node = 0
            while tuple(child[node]) != (node, node):
                node = child[node][int(ratios[feature[node]] >= cut[node])]
            paths.append(path[node])
        return s[0] >= 20 and 100 * s[4] <= 30 * s[0] and 2.0 ** (-np.mean(paths) / forest.norm) < threshold

    now = order(x for x in now if good(x[1]))
    assert stage(0) == now and not any(400 <= (i or 0) < 420 for i, _ in now) and sum((i or 0) < 60 for i, _ in now) >= 60
    now = order(lines_gone(now))
    assert stage(1) == now and sum(COMMON in t for _, t in now) == 1
    # equal texts of one id are one document; the unlike text of id 7 stands for itself
    known = sorted({x for x in now if x[0] is not None})
    numbered = brute_components(list(enumerate(t for _, t in known)))
    least = {}
    for k, (_, c) in numbered.items():
        least[c] = min(least.get(c, known[k][0]), known[k][0])
    kept = {known[k][0] for k, (_, c) in numbered.items() if least[c] == known[k][0]}
    now = order(x for x in now if x[0] is None or x[0] in kept)
    assert stage(2) == now and [i for i, _ in now if i is not None and 300 <= i < 310] == [300]
    bad = {i for i, t in now if i is not None and contaminated(t, items[:2])}
    now = order((i, t) for i, t in now if (i not in bad if i is not None else not contaminated(t, items[:2])))
    assert stage(3) == now and not any(200 <= (i or 0) < 203 for i, _ in now) and sum(i is None for i, _ in now) == 1
    ids = packing.WordIds(packing.tokenizer_path())
    want = []
    for (i, _), x in zip(now, ids.closed([t for _, t in now]), strict=True):
        raw = x.astype("<u4").tobytes()
        want += [(i, p, 2048 * p, len(raw[s : s + 8192]) // 4, zlib.crc32(raw[s : s + 8192])) for p, s in enumerate(range(0, len(raw), 8192))]
    for packed in (corpus_pipeline.STAGES[4][1](spark, docs, at), corpus_pipeline.run(spark, at)):
        got = packed.collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
        bins = {}
        for r in sorted(got, key=lambda r: r.offset):
            assert bins.setdefault(r.sequence_id, 0) == r.offset
            bins[r.sequence_id] += r.length
        assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_the_pipeline_of_empty_tables(spark, tables, tmp_path):
    at = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, at)
        assert docs.columns[0] == "doc_id" and docs.count() == 0
    assert corpus_pipeline.run(spark, at).count() == 0


def test_no_labels_or_items(spark, tables, tmp_path):
    at = str(tmp_path)
    spark.read.parquet(f"{tables[0]}/documents.parquet").where(F.col("doc_id") < 60).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).select("doc_id").collect()} == set(range(60))
