"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams and itself, so a misspelling
shares most of its vectors with the word it stands for. Embeddings and softmax
are trained jointly in numpy: first on whole documents, then on the windows
that carry the label. A document scores as its most toxic window of words.

Defined results: a null or empty text has no window and scores near 0; repeated
rows score alike, and the longest row of a repeated id is fitted on; a null id
is scored, and never fitted on; without labelled rows of both kinds every score
is 0; an empty table gives an empty one. Only the id and the text of a document
are read for its score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import crc_mod, hashed_rows, map_batches, runs_by_size

#: Labelled rows, chosen by hash of the id, that the classifier is fitted on at most.
SAMPLE_ROWS = 4_000
#: Characters of their texts at most, in that order; a row whose text goes beyond what is left is passed over, never cut.
SAMPLE_CHARS = 24_000_000
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 12, 6
#: A bag is averaged over so many n-grams at least, so that a few words alone do not speak too loudly.
LEAST_BAG = 60
DOC_EPOCHS, WINDOW_EPOCHS = 3, 5
SEED = 11
CACHE_WORDS = 300_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+", re.UNICODE)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) pairs in owner order: for each word itself and its n-grams between boundary marks."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()), _PRIME), dtype=np.uint64)
        whole = np.add.reduceat((codes + np.uint64(1)) * power[np.arange(len(codes)) - first[owner]], first)
        owners, hashes = [np.arange(len(marked))], [whole]
        for n in GRAMS:
            m = len(codes) - n + 1
            if m > 0:
                h = np.full(m, np.uint64(n))
                for k in range(n):
                    h = (h ^ codes[k : k + m]) * _PRIME
                inside = owner[:m] == owner[n - 1 :]
                owners.append(owner[:m][inside])
                hashes.append(h[inside])
        who, h = np.concatenate(owners), np.concatenate(hashes)
        bucket = ((h ^ (h >> np.uint64(31))) * _PRIME >> np.uint64(40)).astype(np.int64) % BUCKETS
    order = np.argsort(who, kind="stable")
    return who[order], bucket[order]


class Bags:
    """Words of a sample as indices; bucket lists in one flat array."""

    def __init__(self, docs: list[list[str]]):
        words = sorted(set().union(*docs))
        self.index = {w: i for i, w in enumerate(words)}
        owner, self.flat = grams(words)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
        self.docs = [np.fromiter(map(self.index.__getitem__, d), np.int32, len(d)) for d in docs]


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n else np.zeros(0, np.int64)


class Model:
    """Embeddings, softmax and the calibration of document scores."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.v = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.ge = np.full((BUCKETS, DIM), 1e-6, np.float32)
        self.gv = np.full((2, DIM), 1e-6, np.float32)
        self.slope, self.shift = 1.0, 0.0

    def weights(self) -> np.ndarray:
        """Per bucket, how far it moves the two logits apart."""
        return self.e @ (self.v[1] - self.v[0])

    def step(self, bags: Bags, rows: list[np.ndarray], size: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One update on bags of words; size is what each bag is averaged over.

        A word's vector is the sum of its buckets' and is made once for all
        bags that hold it.
        """
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        words, at = np.unique(np.concatenate(rows), return_inverse=True)
        n = bags.start[words + 1] - bags.start[words]
        of = np.repeat(np.arange(len(words)), n)
        place = np.arange(len(of)) + np.repeat(bags.start[words] - np.cumsum(n) + n, n)
        used, bucket = np.unique(bags.flat[place], return_inverse=True)
        emb = self.e[used]
        mean = np.zeros((len(rows), DIM), np.float32)
        for k in range(DIM):
            word = np.bincount(of, emb[bucket, k], len(words))
            mean[:, k] = np.bincount(owner, word[at], len(rows)) / size
        z = mean @ self.v.T + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        gv = d.T @ mean
        back = (d @ self.v) / size[:, None]
        g = np.stack([np.bincount(bucket, np.bincount(at, back[owner, k], len(words))[of], len(used)) for k in range(DIM)], 1)
        self.ge[used] += g * g
        self.e[used] -= rate * g / np.sqrt(self.ge[used])
        self.gv += gv * gv
        self.v -= rate * gv / np.sqrt(self.gv)
        self.b -= 0.1 * d.sum(0)


def heard(idx: np.ndarray) -> np.ndarray:
    """False for a word that already stood among the WINDOW - 1 words before it: it counts once in a window."""
    out = np.ones(len(idx), bool)
    order = np.argsort(idx, kind="stable")
    same = (idx[order][1:] == idx[order][:-1]) & (np.diff(order) < WINDOW)
    out[order[1:][same]] = False
    return out


def logits(sums: np.ndarray, counts: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """The logit of each window of a document."""
    at = window_starts(len(idx))
    if not len(at):
        return np.zeros(0)
    s = np.concatenate([[0.0], np.cumsum(np.where(heard(idx), sums[idx], 0.0))])
    c = np.concatenate([[0], np.cumsum(counts[idx])])
    end = np.minimum(at + WINDOW, len(idx))
    return (s[end] - s[at]) / np.maximum(c[end] - c[at], LEAST_BAG)


def train(texts: list[str | None], labels: list[int]) -> Model | None:
    """Joint training: whole documents, then windows, then calibration."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    bags, model, rng = Bags([words_of(t) for t in texts]), Model(), np.random.default_rng(SEED)
    docs, flat, start = bags.docs, bags.flat, bags.start
    counts = np.diff(start)
    some = [i for i in range(len(docs)) if len(docs[i])]
    pos, neg = [i for i in some if y[i] == 1], [i for i in some if y[i] == 0]
    if not pos or not neg:
        return None

    def scored(i):
        return logits(sums, counts, docs[i])

    whole = {i: np.unique(docs[i]) for i in some}
    for _ in range(DOC_EPOCHS):
        order = rng.permutation(np.concatenate([neg, rng.choice(pos, len(neg))]))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            size = np.array([max(counts[whole[i]].sum(), LEAST_BAG) for i in part], np.float32)
            model.step(bags, [whole[i] for i in part], size, y[part], 0.3)
    for _ in range(WINDOW_EPOCHS):
        w = model.weights()
        sums = np.add.reduceat(w[flat], start[:-1])
        examples = []
        for i in pos:
            z = scored(i)
            examples.append((i, int(np.argmax(z)) * STRIDE, 1))
        repeat = max(1, round(3 * len(neg) / len(pos)))
        examples *= repeat
        for i in neg:
            z = scored(i)
            examples += [(i, int(k) * STRIDE, 0) for k in {int(np.argmax(z)), *rng.integers(0, len(z), 2).tolist()}]
        order = rng.permutation(len(examples))
        for k in range(0, len(order), 256):
            part = [examples[j] for j in order[k : k + 256]]
            runs = [docs[i][at : at + WINDOW] for i, at, _ in part]
            size = np.array([max(counts[r].sum(), LEAST_BAG) for r in runs], np.float32)
            model.step(bags, [np.unique(r) for r in runs], size, np.array([t for *_, t in part]), 0.15)
    w = model.weights()
    sums = np.add.reduceat(w[flat], start[:-1])
    top = np.array([scored(i).max() if len(docs[i]) else -1e3 for i in range(len(docs))])[some]
    model.slope, model.shift = calibrate(top, y[some])
    return model


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve whose middle is the cut of fewest errors, midway in its gap."""
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(ys)]) + (len(ys) - ys.sum()) - np.concatenate([[0], np.cumsum(1 - ys)])
    cuts = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    cut = float(np.median(cuts[best]))
    return 4.0 / max(float(np.std(z)), 1e-6), cut


class Scorer:
    """Scores texts with per-word sums kept for the words seen so far."""

    def __init__(self, model: Model):
        self.w, self.slope, self.shift = model.weights(), model.slope, model.shift
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([self._scores(part) for part in runs_by_size(texts)])

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        new = set().union(*words).difference(self.index)
        if len(self.index) + len(new) > CACHE_WORDS:
            self.clear()
            new = set().union(*words)
        new = list(new)
        owner, bucket = grams(new)
        self.index.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
        self.sums = sums = np.concatenate([self.sums, np.bincount(owner, self.w[bucket], len(new))])
        self.counts = counts = np.concatenate([self.counts, np.bincount(owner, minlength=len(new))])
        out = np.zeros(len(texts))
        for i, x in enumerate(words):
            z = logits(sums, counts, np.fromiter(map(self.index.__getitem__, x), np.int32, len(x)))
            t = self.slope * ((z.max() if len(z) else 0.0) - self.shift) if len(z) else -30.0
            out[i] = 1 / (1 + math.exp(-min(max(t, -30.0), 30.0)))
        return out


def fit(docs: DataFrame, labels: DataFrame, learn=None, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Model | None:
    """Train on a bounded sample of labelled rows, chosen by hash among those that learn allows."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    chosen = hashed_rows(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).distinct(), SAMPLE_ROWS, "id", "y")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.length(text).alias("n"))
    # first the lengths alone; one row of an id, so that no more come than were chosen
    sizes = texts.select("id", "n").join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.max("n").alias("n")).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"), "id", "y", "n").collect()
    taken, left = [], SAMPLE_CHARS
    for _, i, v, n in sorted((r.h, r.id, r.y, r.n or 0) for r in sizes):
        if n <= left:
            left -= n
            taken.append((i, v))
    if not taken:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, "id bigint, y int"))
    got = texts.join(few, "id").groupBy("id", "y").agg(F.max(F.struct("n", "text")).alias("t")).select("id", "y", "t.text").toLocalIterator()
    pairs = sorted((r.id, r.y, r.text) for r in got)
    return train([t for *_, t in pairs], [int(v == 1) for _, v, _ in pairs])


def toxicity(docs: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scorer = Scorer(model)

    def run(cols):
        s = scorer.scores(cols["text"])
        return {"doc_id": cols["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_batches(rows, run, "doc_id bigint, score double, predicted int", pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())]), scorer)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are not learned from."""
    return crc_mod(id_col, 5) == 0
