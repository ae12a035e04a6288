"""Quality rules, chat formatting, line dedup, packing and extraction against plain versions, with odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dialoom.llm import chat, html, linededup, packing, quality
from dialoom.llm.common import WordHashes

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
LONG = " ".join(WORDS[i * 7 % 300] + str(i) for i in range(30_000))
ODD = [None, "", " \n\t", "one", "x y z", LONG]
DOCS = "doc_id bigint, text string, kept string, drops int, n_chars bigint"


def prose(i, n=60):
    return " ".join(WORDS[(i * 31 + k * k * 7 + k) % 300] for k in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---- quality rules


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i : i + 8])].append(i)
    cover = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(cover)]


def junk(i):
    return " ".join(w + "###" for w in prose(i).split())


def test_rule_stats():
    for t in [*ODD, prose(1), prose(1, 12) + " " + prose(1, 12), "a\na\n\n\nb a\na", junk(3), "a " * 30]:
        assert quality.rule_stats(t, WordHashes())[0] == plain_stats(t)


def test_quality_verdicts(spark):
    texts = [prose(i, 40 + i % 50) for i in range(120)] + [junk(i) for i in range(20)] + ODD
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 140, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, texts)
    got = {r.doc_id: r for r in quality.quality_rules(d, labels).collect()}
    assert len(got) == len(texts)
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, 145))
    for i, t in enumerate(texts):
        s = plain_stats(t)
        assert got[i].base_failed == (s[0] < 20 or 100 * s[4] > 30 * s[0])
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.quality_rules(docs(spark, [prose(1), None]), none).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False]
    assert quality.quality_rules(docs(spark, []), none).count() == 0


# ---- chat formatting


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "s <|turn|> [INST] \\ \\\\ <\\ [\\"),
        (1, 1, "user", "</s>[INST] ok [/INST]"),
        (1, 2, "assistant", "a<|end|>\n<|turn|>user\nb"),
        (2, 0, "user", None),
        (2, 1, "assistant", ""),
        (3, 0, "assistant", "first"),
        (4, 0, None, "no role"),
        (4, 1, "odd role\n<x>", "t"),
        (5, 0, "user", LONG),
        (5, 0, "user", LONG),
        (None, None, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert {c for c, r in got.items() if r.valid_order} == {1, 2, None}
    text = chat.format_chat(df.where("conv_id = 1")).first().formatted
    assert text.count("<|turn|>") == 3 and text.count("<|end|>") == 3 and "[INST]" not in text and "</s>" not in text
    assert chat.chat_digest(df.limit(0)).count() == 0


# ---- line dedup


def plain_line_dedup(texts):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out.append((len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    common = "This line is found in very many documents"
    texts = [f"{common}\n{prose(i, 8)}\n  {common.upper()}\t" for i in range(30)]
    texts += [common + "\n" + common, "\n\n", "short\nshort", "É" * 20 + "\nx", "É" * 20, "é" * 20, "É" * 20 + " ", *ODD]
    texts += [f"only twice in all the documents {i // 2}" for i in range(8)]
    d = docs(spark, texts)
    got = [tuple(r)[1:] for r in linededup.line_digest(d).orderBy("doc_id").collect()]
    assert got == plain_line_dedup(texts)
    out = linededup.without_lines(d)
    assert out.columns == d.columns and out.count() == len(texts)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert linededup.line_digest(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, common)] * 4, "doc_id bigint, text string")
    assert [r.n_dropped for r in linededup.line_digest(nulls).collect()] == [0] * 4


# ---- packing


def test_ids_are_the_tokenizers():
    ids = packing.WordIds(packing.tokenizer_path())
    texts = [prose(3), "Hi, you. No ,a", "it's, 's. 3.14", "... . ,,a b.", "x <|endoftext|> y", "É. È,. ½ a² µm ß", "A\tB c\r\nd  e", "İ ΣΑΣ", "", "é a"]
    want = [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.ids(texts)] == want


def test_packing(spark):
    texts = [prose(i, 20 + i * 13 % 400) for i in range(150)] + ODD
    rows = packing.pack(docs(spark, texts)).collect()
    ids = packing.WordIds(packing.tokenizer_path())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, raw in enumerate(ids.ids(texts)):
        all_ids = raw + b"\0\0\0\0"
        total += len(all_ids) // 4
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = all_ids[4 * at : 4 * (at + r.length)]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part))
            at += r.length
        assert at * 4 == len(all_ids) and all(r.length == 2048 for r in pieces[i] if r.piece < len(pieces[i]) - 1)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_crossover_loses_nothing():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 300).tolist()
    a, b = (packing.Person.packed(lengths, [rng.permutation(300).tolist()], 2048) for _ in range(2))
    for _ in range(5):
        a, b = b, packing.cross(a, b, lengths, 2048, rng)
        assert sorted(i for x in b.bins for i in x) == list(range(300))
        assert all(sum(lengths[i] for i in x) + r == 2048 and r >= 0 for x, r in zip(b.bins, b.room, strict=True))


# ---- extraction

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home</ul></nav><div class='ad'>buy</div>{body}<footer>&copy; us</footer>"


def test_article_text(spark):
    body = "<article><h1>Head &amp; tail</h1><p><b>First<br>line\n two&nbsp;x.<p>Second<script>no()</script></p><div class='comments'><p>me too</div></article>"
    rows = [
        (1, "http://h/a/1", PAGE.format(body=body)),
        (2, "http://h/a/2", None),
        (3, "http://h/a/3", ""),
        (4, None, "plain <b>text"),
        (5, "http://g/x/1", "<div>Shared frame line</div><div>Only one</div><p>Alone too"),
        (6, "http://g/x/2", "<div>Shared frame line</div><div>Another</div><p>Not the same"),
        (7, "http://h/a/1", PAGE.format(body=body)),
    ]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == got[7].text == "Head & tail\n\nFirst line two x.\n\nSecond"
    assert (got[2].text, got[3].text, got[4].text) == ("", "", "plain text")
    assert got[5].text == "Only one\n\nAlone too" and got[6].text == "Another\n\nNot the same"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shared_is_a_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.permutation(12).tolist()[:9], rng.permutation(12).tolist()[:9]
    got = [a[i] for i in html.shared(a, b)]
    best = [[0] * 10 for _ in range(10)]
    for i in range(9):
        for j in range(9):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(got) == best[9][9] and [b.index(x) for x in got] == sorted(b.index(x) for x in got)


def test_partitions_do_not_matter(spark):
    rows = [(i, f"http://h/{i // 7}/{i}", f"<div>frame {i // 14}</div><div>own {i}</div>") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(tuple, html.extract(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and sum(r[4] for r in out[0]) > 70




@pytest.mark.parametrize("name", ["other", "same"])
def test_ids_of_any_tokenizer(tmp_path, name):
    """A tokenizer that does not lower-case, or splits in another way, is asked for whole texts."""
    import json

    said = json.loads(packing.WordIds(packing.tokenizer_path()).tokenizer.to_str())
    if name == "other":
        said["normalizer"] = None
    at = tmp_path / "t.json"
    at.write_text(json.dumps(said))
    ids = packing.WordIds(str(at))
    assert ids.by_words == (name == "same")
    texts = ["Hi, you. No ,a", "ÉÀ it's 's x1y22&&&...", "", "A\n\nB"]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.ids(texts)] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("words", [1, 400_000])
def test_forgetting_words_changes_no_id(monkeypatch, words):
    monkeypatch.setattr(packing, "CACHE_WORDS", words)
    monkeypatch.setattr(packing, "RUN_CHARS", 100)
    ids = packing.WordIds(packing.tokenizer_path())
    texts = [prose(i) for i in range(20)] + ODD + ["é日本 1a" * 9]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.ids(texts)] == [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_repeated_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 200)
    df = spark.createDataFrame([(1, "the same")] * 1200 + [(None, None)] * 3, "doc_id bigint, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 1203 and sum(r.doc_id is None for r in rows) == 3
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.sequence_id >> 24] += 1
    assert len(sizes) > 3 and max(sizes.values()) < 320


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_the_least_number_of_bins(seed):
    """On sets small enough to try every packing, the evolved one needs no bin more."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(200, 1500, 9).tolist()

    def least(rest, rooms, best):
        if len(rooms) >= best:
            return best
        if not rest:
            return len(rooms)
        for k, room in enumerate(rooms):
            if room >= rest[0] and room not in rooms[:k]:
                best = least(rest[1:], rooms[:k] + [room - rest[0]] + rooms[k + 1 :], best)
        return least(rest[1:], [*rooms, 2048 - rest[0]], best)

    got = packing.evolve(lengths, [], seed)
    assert sorted(i for b in got.bins for i in b) == list(range(9))
    assert len(got.bins) == least(sorted(lengths, reverse=True), [], 10)


def test_line_dedup_beside_clashing_names(spark):
    common = "This line is found in very many documents"
    names = ["line_dedup", "LINE_DEDUP_", "row", "lines", "drops", "kept", "i", "stay", "n_lines", "n_dropped", "h1", "odd.name"]
    df = spark.createDataFrame([(i, f"{common}\nown {i}", 1, *names) for i in range(4)], "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "line_dedup__"] and all(r["odd.name"] == "odd.name" and r["row"] == "row" for r in out.collect())
    left = linededup.without_lines(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars, r.line_dedup) for r in left.collect()) == [(i, f"own {i}", len(f"own {i}"), "line_dedup") for i in range(3)] + [(3, f"{common}\nown 3", 1, "line_dedup")]


def test_line_dedup_of_very_many_lines(spark):
    texts = ["\n".join(f"a line that many documents hold {i * k % 150_000}" for i in range(200_000)) for k in (1, 7, 11)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in linededup.line_digest(df).orderBy("doc_id").collect()]
    assert got == plain_line_dedup(texts)


@pytest.mark.parametrize("text", ["", "a | b", "| | |", "x1 1 && &&a é ß| …", " \n", "ab"])
def test_bare_words(text):
    plain = sum(not any(c.isalnum() or ord(c) > 127 for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    assert quality.bare_words(np.frombuffer(text.encode(), np.uint8)) == plain


def test_path_lengths_and_the_anomaly():
    """The forest's scores against a walk down every tree, row by row; a value no good row has is isolated soonest."""
    rng = np.random.default_rng(3)
    good = rng.uniform(0, 0.1, (400, len(quality.FEATURES)))
    forest = quality.Forest(good)
    odd = good[:4].copy()
    odd[:, 2] = 0.8
    rows = np.concatenate([good[:20], odd, np.ones((1, good.shape[1]))])

    def path(tree, x):
        feature, cut, child, length = tree
        at = depth = 0
        while tuple(child[at]) != (at, at):
            at, depth = child[at][int(x[feature[at]] >= cut[at])], depth + 1
        assert length[at] >= depth
        return length[at]

    mean = np.array([np.mean([path(t, x) for t in forest.trees]) for x in rows])
    got = forest.anomaly(rows)
    assert got == pytest.approx(2.0 ** (-mean / forest._expected(quality.ROWS_PER_TREE)), rel=1e-5)
    assert got[20:].min() > got[:20].max()


def test_calibration_keeps_the_good_rows():
    anomaly = np.concatenate([np.linspace(0.3, 0.5, 1000), [0.45, 0.6, 0.7]])
    good = np.arange(1003) < 1000
    assert 0.5 < quality.calibrate(anomaly, good) < 0.6
    assert quality.calibrate(anomaly[:1000], good[:1000]) > 0.5


def test_quality_of_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(i // 2, prose(i) if i % 4 else junk(i), "q", 1, 2) for i in range(80)] + [(None, prose(5), "q", 1, 2)], "doc_id bigint, text string, q string, id int, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)] * 3 + [(None, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    got = quality.quality_rules(df, labels).collect()
    assert len(got) == 81 and sum(r.doc_id is None for r in got) == 1
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_samples_are_exact_whatever_the_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from dialoom.llm.common import hashed_rows

    rows = spark.range(5000).withColumn("y", F.lit(1))
    h = F.shiftrightunsigned(F.xxhash64("id"), 1)
    for limit in (1, 50, 400, 9000):
        want = [r.id for r in rows.orderBy(h, "id").limit(limit).collect()]
        assert sorted(want) == sorted(r.id for r in hashed_rows(rows, limit, "id", "y").collect())
    same = spark.range(5000).select(F.lit(3).cast("bigint").alias("id"), F.col("id").alias("y"))
    assert hashed_rows(same, 40, "id", "y").count() == 40
    assert hashed_rows(rows.limit(0), 40, "id", "y").count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_shared_with_repeated_lines(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, 14).tolist(), rng.integers(0, 5, 11).tolist()
    best = [[0] * 12 for _ in range(15)]
    for i in range(14):
        for j in range(11):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    got = html.shared(a, b)
    assert len(got) == best[14][11] and got == sorted(set(got))
    rest = iter(b)
    assert all(a[i] in rest for i in got)  # in b's order too
    assert html.shared([1, 2, 1], [2, 1]) == [1, 2]


def test_very_many_equal_lines_are_aligned(monkeypatch):
    a = [1] * 3000 + [2] + [3] * 3000
    assert html.shared(a, a) == list(range(len(a)))  # beyond ALIGNED_PAIRS
    monkeypatch.setattr(html, "ALIGNED_PAIRS", 0)
    assert html.shared([5, 1, 2, 1, 9], [1, 2, 1]) == [1, 2, 3]


@pytest.mark.parametrize(
    "bad",
    ["<a b=", "<![CDATA[x", "<!--", "<a b='x>", '<a b="><i c=', "<", "</", "<!x", "<p", "<a 'x> ", "<script>", "&amp", "<div><i>", "<p></p><i>", "<b></q>", "<a b = \"'", "<a \"'=", "<i>" * 9 + "</p>"],
)
def test_broken_markup_takes_time_in_proportion(bad):
    import time

    took = []
    for n in (100_000, 400_000):
        start = time.perf_counter()
        html.blocks(bad * (n // len(bad)) + "<p>end")
        took.append(time.perf_counter() - start)
    assert took[1] < 0.4 + 12 * took[0]


def test_a_long_page_is_read_whole():
    words = [f"w{i}" for i in range(200_000)]
    page = "<article>" + "".join(f"<p>{' '.join(words[i : i + 50])}</p>" for i in range(0, len(words), 50)) + "</article>"
    bs = html.blocks("<a b=" * 200_000 + ">" + page)
    assert len(bs) == 4000 and " ".join(b.text for b in bs).split() == words
    assert [b.text for b in html.blocks("<i>" * 100_000 + "x" + "</q>" * 100_000 + "<div>y</div>")] == ["x", "y"]


def test_tags_with_quotes():
    text = lambda s: [b.text for b in html.blocks(s)]
    assert text("<p title='a > b'>x</p>") == ["x"]
    assert text('<p title = "<p>a\'s</p>">x<b class=y>z</b></p>') == ["xz"]
    assert text("<p it's>x</p><p>it's</p>") == ["x", "it's"]
    assert text("1 < 2 <p>3 <4</p> 5<6") == ["1 < 2", "3 <4", "5<6"]
    assert text("<p>a<![CDATA[<b>&amp;]]>c") == ["a<b>&amp;c"]
    assert text("<p>a<!-- <p>b --><?x y?><!DOCTYPE z>c</p><!-- open <p>d") == ["ac"]
    assert text("<script>if (a < b) '</p>'</script ><p>x<textarea>y</p></textarea>z<br/>w") == ["xz w"]
    assert text("<p>open <a href='") == ["open <a href='"]


def test_parts_inside_an_article():
    page = '<article><header><h1>Title here</h1></header><p>Body</p><div class="search-results menu-items"><p>Recipe text</p></div>{}<footer>by us</footer></article><header>Site</header>'
    keep = lambda s: [b.text for b, k in zip(html.blocks(s), html.keep_of(html.blocks(s))[0], strict=True) if k]
    assert keep(page.format("")) == ["Title here", "Body", "Recipe text"]
    for gone in ('<div class="comment-list"><p>me too</p></div>', '<div class="menu"><p>x</p></div>', '<aside>x</aside>', '<form><p>x</p></form>', '<div role="search">x</div>', '<p class="ad-slot">x</p>', "<div hidden>x</div>", '<div class="notice">x</div>'):
        assert keep(page.format(gone)) == ["Title here", "Body", "Recipe text"]
    assert keep('<div class="main-menu">x</div><div>y</div>') == ["y"]


def test_frames_in_variants_and_copies(spark):
    """Frame lines that only some near pages share go; copies of a page, and a page alone on its host, lose nothing."""
    rows = [(i, f"http://h/{i // 40}/{i:03}", f"<div>frame {i % 3}</div><div>own {i}</div><div>more {i}</div><div>foot {i % 2}</div>") for i in range(80)]
    rows += [(100, "http://alone/x", "<div>frame 0</div><div>only</div>"), (101, "http://copy/a", "<div>l1</div><div>l2</div><div>l3</div>"), (102, "http://copy/b", "<div>l1</div><div>l2</div><div>l3</div>")]
    rows += [(7, "http://h/0/007", "<div>frame 1</div><div>another text of page 7</div>"), (None, "http://h/0/008", "<div>frame 1</div><div>no id</div>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash") for c in ("row", "host", "path", "kept", "drops", "place", "block", "rank")})
    got = html.extract(df).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "n_shared"} and len(got) == len(rows)
    texts = sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got)
    want = [(i, f"own {i}\n\nmore {i}") for i in range(80)] + [(100, "frame 0\n\nonly"), (101, "l1\n\nl2\n\nl3"), (102, "l1\n\nl2\n\nl3"), (7, "another text of page 7"), (-1, "no id"), (-1, "")]
    assert texts == sorted(want)


# ---- names of parts, and articles beside the text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="no-sidebar"><div class="post no-sidebar"><p>Hello there</p></div></body>', ["Hello there"]),
        ('<div id="content"><p>The long main text.</p></div><article class="teaser"><p>Read more</p></article>', ["The long main text."]),
        ('<div id="content"><p>The long main text of a page.</p></div><article><p>Short</p></article>', ["The long main text of a page.", "Short"]),
        ('<article><p>The text.</p></article><article class="comment"><p>nice post</p></article>', ["The text."]),
        ('<article><p>The text.</p></article><article class="widget ad"><p>buy</p></article>', ["The text."]),
        ("<main hidden><p>secret</p></main><p>open</p>", ["open"]),
        ('<article><p>One.</p><div class="related-posts"><p>see</p></div><div class="share-price-table"><p>12</p></div></article>', ["One.", "12"]),
        ('<article><div class="ad-hoc"><p>x</p></div><div id="comment-analysis"><p>y</p></div><p class="comment">z</p><div class="share-buttons">w</div></article>', ["x", "y", "z"]),
        ('<div class="site-header"><p>a</p></div><div class="main-nav-wrapper"><p>b</p></div><p>T</p>', ["T"]),
    ],
)
def test_names_of_parts(page, want):
    bs = html.blocks(page)
    assert [b.text for b, keep in zip(bs, html.keep_of(bs)[0]) if keep] == want


@pytest.mark.parametrize("seed", range(40))
def test_alignment_does_not_depend_on_the_number_of_pairs(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, rng.integers(2, 9), rng.integers(0, 60)).tolist() for _ in range(2))
    want = html.shared(a, b)
    monkeypatch.setattr(html, "ALIGNED_PAIRS", 0)
    assert html.shared(a, b) == want
    assert html.shared([1] * 9 + [2], [2] + [1] * 9) == list(range(9)) and html.shared([1, 2, 1, 3], [3, 1, 1]) == [0, 2]


@pytest.mark.parametrize("bad", [0, 300])
def test_threshold_over_all_labelled_rows(spark, bad):
    """The threshold that aggregates find is the one of all rows together."""
    rng = np.random.default_rng(bad)
    anomaly = np.concatenate([rng.normal(0.4, 0.05, 3000), rng.normal(0.6, 0.08, bad)]).clip(0, 1)
    good = np.arange(len(anomaly)) < 3000
    df = spark.createDataFrame([(bool(g), float(a)) for g, a in zip(good, anomaly, strict=True)], "good boolean, anomaly double").repartition(5)
    assert quality.threshold_of(df) == quality.calibrate(anomaly, good)
    assert not hasattr(quality, "SAMPLE_ROWS")


def test_labelled_statistics_shuffle_no_text(spark):
    """However large the labels, no join or exchange of the fit holds a text."""
    df = docs(spark, [prose(i) for i in range(60)])
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 80, 2)], "id bigint, q int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = quality.labelled_stats(df, known, "text", "doc_id")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "text" in plan and "text" not in plan[plan.index("Join") : plan.index("MapInArrow")]
        want = {(i, int(i % 3 > 0)): quality.rule_stats(prose(i), WordHashes()) for i in range(0, 60, 2)}
        assert {(r.id, r.q): ([r.words, r.repeats], r.x) for r in got.collect()} == {k: ([s[0], s[4]], x) for k, (s, x) in want.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_forest_counts_every_good_row(spark):
    """More good rows than were ever drawn, in several tasks: the forest is that of all of them."""
    x = np.random.default_rng(5).uniform(0, 1, (40_000, len(quality.FEATURES))) ** 3
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    got, want = quality.grown(df), quality.Forest(x)
    assert all(np.array_equal(a, b) for t, u in zip(got.trees, want.trees, strict=True) for a, b in zip(t, u, strict=True))
    feature, cut = quality.splits()
    assert quality.leaf_counts(x, feature, cut).sum() == quality.TREES * len(x)
    assert not hasattr(quality, "hashed_rows")
