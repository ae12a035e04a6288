"""Cross-tokenizer alignment against whole tokenisations and all overlaps."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dialoom.llm import alignment

DOCS = "doc_id bigint, text string, key string, n int"
FIELDS = "n_a n_b n_groups n_links n_best count_sum groups".split()
ODD = [
    None,
    "",
    " ",
    "   ",
    "a",
    " lead and  two   spaces ",
    "tab\tand\nline\n\nbreaks \n end",
    "it's we'll DON'T 12 345 x1y2",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a▁b marks",
    "▁",
    "naïve café übel Ångström",
    "日本語 テキスト 한국어",
    "e\u0301 combining",
    "no\u00a0break\u3000wide\u2003em x\x1cy \x85 z",
    "nul \x00 in",
    "😀 emoji 👩‍👩‍👧 here",
    "x" * 5000,
    "word " * 3000,
    "the the the cat sat on the mat.",
    "the cat sat on the mat.",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(self, p):
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def spans(self, tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def of(self, text):
        """Spans of A and of B, or None."""
        if not text:
            return None
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, self.piece(self.b.id_to_piece(i))) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (self.spans(a), self.spans(b)) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def plain(texts):
    both = list(map(Plain().of, texts))
    links = [[(i, j) for i, s, e in x[0] for j, u, v in x[1] if s < v and u < e] if x and len(x[0]) < 400 else swept(*x) if x else [] for x in both]
    count = Counter(k for x in links for k in x)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for x, ls in zip(both, links):
        if not x:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for *_, e in x[0]} & {e for *_, e in x[1]})
        groups = ";".join(",".join(str(i) for i, s, e in x[0] if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in x[1] if lo <= s and e <= hi) for lo, hi in zip([0, *ends], ends)) if len(ends) < 400 else None
        out.append((len(x[0]), len(x[1]), len(ends), len(ls), sum(count[k] == most[k[1]] for k in ls), sum(count[k] for k in ls), groups))
    return out, count


def swept(a, b):
    """All overlaps of two sorted lists of spans."""
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def same(got, want):
    assert got[:6] == want[:6]
    if want[6] is not None:
        assert got[6] == want[6]


@pytest.mark.parametrize("cache", [alignment.CACHE_UNITS, 3])
def test_as_all_overlaps(spark, cache):
    texts = ODD + ODD[-2:] + ["the cat <|endoftext|>▁ sat"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "the cat", "clash", 1)], DOCS).repartition(3)
    want, _ = plain([*texts, "the cat"])
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.alignments(df, cache_units=cache).collect()}
    assert len(got) == len(texts) + 1
    for i, w in zip([*range(len(texts)), None], want):
        same(got[i], w)
    hashed = {r.doc_id: r.groups_sha256 for r in alignment.alignments(df, hashed=True).collect()}
    assert hashed == {i: hashlib.sha256(v[6].encode()).hexdigest() if v[0] else "" for i, v in got.items()}


def test_no_rows_and_no_tokens(spark):
    assert not alignment.alignments(spark.createDataFrame([], DOCS)).collect()
    got = alignment.alignments(spark.createDataFrame([(1, None, "x", 1), (2, "▁", "x", 1)], DOCS)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_shards_hold_each_key_once_in_order(spark, tmp_path):
    rows = [(int(k) % 997 - 3, 1 + k % 5) for k in range(20_000)]
    rows = [(abs(k) << alignment.A_BITS | k % 7, n) for k, n in rows]
    shards, best = alignment.write_shards(spark.createDataFrame(rows, "key bigint, n bigint").repartition(5), str(tmp_path / "s"))
    want = Counter()
    for k, n in rows:
        want[k] += n
    assert alignment.pair_counts(shards) == {(k & 0xFFFFFFFF, k >> alignment.A_BITS): n for k, n in want.items()}
    assert all(a[2] < b[1] for a, b in zip(shards, shards[1:]))
    assert best == {b: max(n for k, n in want.items() if k >> alignment.A_BITS == b) for b in {k >> alignment.A_BITS for k in want}}
    import numpy as np

    asked = np.array([*want, 5 << 60])
    assert alignment.Counts(shards).of(asked).tolist() == [*want.values(), 0]
