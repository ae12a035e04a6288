"""Language ID: nearest clustered centroid of TF-IDF character n-grams.

A text becomes a vector of hashed n-grams of one to three characters, with
inverse document frequencies over all training documents, at unit length.
Each language has several centroids (spherical k-means over a bounded sample);
the nearest by cosine names the language, and a text farther from it than
nearly all training texts of that language is rejected.

Defined results: a null text and one without letters are `und` with score 0;
repeated rows agree, and one row of a repeated id is fitted on; of languages
equally near the first in order is named; a null id is judged, and never
fitted on; without training rows every text is `und`; an empty table
gives an empty one. Only the id, the text and, for training, the language are
read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import crc_mod, in_batches, map_batches

UNKNOWN = "und"
BUCKETS = 4096
ORDERS = (1, 2, 3)
#: Training rows, chosen by hash of the id, that the centroids are fitted on at most: each language has an equal part. Frequencies take all.
SAMPLE_ROWS = 4_000
#: Languages that are learned at most, the most frequent ones, so that each has LEAST_ROWS.
LANGUAGES = 200
LEAST_ROWS = SAMPLE_ROWS // LANGUAGES
#: Centroids of a language; one only where it has fewer than 20 rows, and one more for each ten.
CENTROIDS = 4
ROUNDS = 12
#: Share of a language's training texts that may lie beyond its rejection distance.
REJECT = 0.005
SEED = 5

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(0, bool)
#: No assigned letter lies beyond.
LAST_LETTER = 0x32400


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(i).isalpha() for i in range(LAST_LETTER)] + [False])
    return _LETTER


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter. Other characters count as one space."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(c, LAST_LETTER)]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]]).astype(np.uint64)
    out = np.zeros(BUCKETS)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(c) - n + 1
            h = np.full(m, np.uint64(n))
            for k in range(n):
                h = (h ^ c[k : k + m]) * _PRIME
            out += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str] = field(default_factory=list)
    reject: dict[str, float] = field(default_factory=dict)

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        n = np.linalg.norm(v)
        return v / n if n else v

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, cosine with its nearest centroid, and whether that is too small."""
        names, scores, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        for at in range(0, len(texts), 256):
            got = [(i, x) for i in range(at, min(at + 256, len(texts))) if (x := gram_counts(texts[i])) is not None]
            if got and self.langs:
                cos = np.stack([self.vector(x) for _, x in got]) @ self.centroids.T
                for (i, _), row in zip(got, cos, strict=True):
                    k = int(np.argmax(row))
                    names[i], scores[i] = self.langs[k], min(max(float(row[k]), 0.0), 1.0)
                    far[i] = scores[i] < self.reject[self.langs[k]]
        return names, scores, far


def cluster(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means; empty clusters take the row farthest from its centroid."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        cos = x @ c.T
        at = cos.argmax(1)
        for j in range(k):
            mine = x[at == j]
            v = mine.sum(0) if len(mine) else x[cos.max(1).argmin()]
            c[j] = v / max(np.linalg.norm(v), 1e-12)
    return c


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs; a partition's counts are summed before they are shuffled."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                x = gram_counts(t)
                if x is not None:
                    df += x > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["k", "n"])

    got = {r.k: r.n for r in in_batches(rows, run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return np.array([got.get(k, 0) for k in range(BUCKETS)], float), int(got.get(-1, 0))


def sampled(rows: DataFrame) -> DataFrame:
    """The (id, lang) that the centroids are fitted on: of each of the most frequent languages those of least hash.

    A threshold on the hash for each language, set from its row count, leaves
    about twice as many as are wanted, so the exact cut sees a bounded number.
    """
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return rows.limit(0)
    each = max(SAMPLE_ROWS // len(sizes), LEAST_ROWS)
    h = F.shiftrightunsigned(F.xxhash64("id"), 1)
    share = lambda n: min(1.0, (2 * each + 6 * (2 * each) ** 0.5) / n)
    least = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(share(r.n) * ((1 << 63) - 1024)))])
    few = rows.where(h <= F.coalesce(F.element_at(least, F.col("lang")), F.lit(-1))).distinct()
    return few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(h, "id"))).where(F.col("k") <= each).select("id", "lang")


def fit(docs: DataFrame, learn: Column | None = None, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> Model:
    """Frequencies from all rows that may be learned from, centroids from a bounded sample of them."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    rows = (rows.where(learn) if learn is not None else rows).select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    df, n = _frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    chosen = sampled(rows.select("id", "lang"))

    def counts(c):
        both = [(i, v, gram_counts(t)) for i, v, t in zip(c["id"], c["lang"], c["text"], strict=True)]
        both = [x for x in both if x[2] is not None]
        return {"id": [i for i, _, _ in both], "lang": [v for _, v, _ in both], "x": [x.astype(np.float32) for _, _, x in both]}

    arrow = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("x", pa.list_(pa.float32()))])
    counted = map_batches(rows.join(F.broadcast(chosen), ["id", "lang"]), counts, "id bigint, lang string, x array<float>", arrow)
    # one row of an id, so that no more come than were chosen
    got = counted.groupBy("id", "lang").agg(F.min("x").alias("x")).toLocalIterator()
    model = Model(idf, np.zeros((0, BUCKETS)))
    by: dict[str, list[np.ndarray]] = {}
    for r in got:
        by.setdefault(r.lang, []).append(model.vector(np.array(r.x, np.float64)).astype(np.float32))
    rng = np.random.default_rng(SEED)
    all_c = []
    for name in sorted(by):
        x = np.stack(sorted(by[name], key=lambda v: v.tobytes()))
        c = cluster(x, min(CENTROIDS, max(1, len(x) // 10)), rng)
        all_c.append(c)
        model.langs += [name] * len(c)
        model.reject[name] = float(np.quantile((x @ c.T).max(1), REJECT))
    if all_c:
        model.centroids = np.concatenate(all_c)
    return model


def languages(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row; lang_pred is the nearest language even if rejected."""

    def run(c):
        names, scores, far = model.predict(c["text"])
        return {"doc_id": c["doc_id"], "lang_pred": names, "score": scores, "rejected": far}

    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, lang_pred string, score double, rejected boolean", arrow)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from."""
    return crc_mod(id_col, 4) == 2
