"""Quality rules: an isolation forest over rule statistics.

Each document gets rule statistics from its whole text. A forest of random
splits isolates rows unlike the labelled good ones, all of which are counted
in every tree, after few splits; the path length is the verdict, and its
threshold is calibrated on labelled rows.

Defined results: a null text counts as no words (base_failed); repeated rows
and repeated ids are judged row by row, and one row of a repeated id is fitted
on; a null id is judged, and never fitted on; without labelled rows of both kinds
only the base rules decide; an empty table gives an empty one. Input columns
other than the id and the text are never read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import WordHashes, checkpointed, filter_place, id_filter, in_batches, in_filter, map_batches, slices, windows
from dialoom.operators.samples import ranked

TREES = 128
ROWS_PER_TREE = 256
DEPTH = 12
#: Share of labelled good rows that the threshold must keep.
KEEP_GOOD = 0.998
SEED = 20_240_101

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each ratio lies from 0 to 1, and splits fall anywhere in that range; roots spread small shares.
FEATURES = ("root_symbols", "dup_lines", "repeats", "upper", "stutter", "word_len", "root_bangs", "root_bare")

#: Bytes of UTF-8 that are, or belong to, a letter or a digit; characters beyond ASCII count as such.
_SPEAKING = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_SPACE = np.array([chr(b) in SPACES for b in range(256)])


def bare_words(codes: np.ndarray) -> int:
    """Words without a letter or a digit."""
    space = _SPACE[codes]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    return int(np.count_nonzero(~np.logical_or.reduceat(_SPEAKING[codes], starts))) if len(starts) else 0


def rule_stats(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The five counts of STATS and the ratios of FEATURES for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeats = stutter = 0
    if n > 1:
        h = hashes.array(words)
        stutter = int(np.count_nonzero(h[1:] == h[:-1]))
        w = windows(h, WINDOW)
        if len(w) > 1:
            s = np.sort(w)
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            if len(twice):
                starts = np.flatnonzero(np.isin(w, twice))
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + WINDOW, -1)
                repeats = int(np.count_nonzero(np.cumsum(cover[:n]) > 0))
    codes = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    c, m = max(chars, 1), max(n, 1)
    ratios = [math.sqrt(symbols / c), dups / max(lines, 1), repeats / m, min(upper / c, 1.0), stutter / m, min(chars / m, 25.0) / 25.0, math.sqrt(text.count("!") / c), math.sqrt(bare_words(codes) / m)]
    return [n, chars, symbols, dups, repeats], ratios


def splits(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The feature and the place of every split that a tree may make, by tree and node; node i has the children 2i and 2i + 1."""
    rng = np.random.default_rng(seed)
    feature, cut = np.zeros((TREES, 1 << DEPTH), np.int8), np.zeros((TREES, 1 << DEPTH))
    for t in range(TREES):
        lo, hi = np.zeros((1, len(FEATURES))), np.ones((1, len(FEATURES)))
        for d in range(DEPTH):
            n = 1 << d
            f, row = rng.integers(len(FEATURES), size=n), np.arange(n)
            at = rng.uniform(lo[row, f], hi[row, f])
            feature[t, n : 2 * n], cut[t, n : 2 * n] = f, at
            lo, hi = np.repeat(lo, 2, 0), np.repeat(hi, 2, 0)
            hi[2 * row, f] = lo[2 * row + 1, f] = at
    return feature, cut


def leaf_counts(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many of the rows come to each node of the last depth, by tree."""
    rows = np.arange(len(x))
    out = np.zeros((TREES, 1 << DEPTH), np.int64)
    for t in range(TREES):
        at = np.ones(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + (x[rows, feature[t, at]] >= cut[t, at])
        out[t] = np.bincount(at - (1 << DEPTH), minlength=1 << DEPTH)
    return out


class Forest:
    """Random axis splits over the whole range of each ratio; short mean paths mark anomalies.

    The splits do not depend on rows, so that how many of all good rows lie in
    a node is a sum; it counts as its expectation among ROWS_PER_TREE rows, and
    a node of one row or less is not split.
    """

    def __init__(self, good: np.ndarray | None, seed: int = SEED, counts: np.ndarray | None = None):
        feature, cut = splits(seed)
        if counts is None:
            counts = leaf_counts(good, feature, cut)
        share = min(1.0, ROWS_PER_TREE / max(int(counts[0].sum()), 1))
        self.trees = [self._grow(f, c, n * share) for f, c, n in zip(feature, cut, counts, strict=True)]
        self.norm = self._expected(ROWS_PER_TREE)

    @staticmethod
    def _expected(n: float) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, features, cuts, mass):
        levels = [mass]
        for _ in range(DEPTH):
            levels.append(levels[-1].reshape(-1, 2).sum(1))
        inside = np.concatenate([[0.0], *levels[::-1]])
        feature, cut, child, path = [], [], [], []

        def node(i, depth):
            me = len(feature)
            feature.append(0), cut.append(0.0), child.append((me, me)), path.append(depth + self._expected(inside[i]))
            if inside[i] <= 1 or depth >= DEPTH:
                return me
            feature[me], cut[me] = features[i], cuts[i]
            left = node(2 * i, depth + 1)
            right = node(2 * i + 1, depth + 1)
            child[me] = (left, right)
            return me

        node(1, 0)
        return np.array(feature, np.int8), np.array(cut), np.array(child, np.int32), np.array(path, np.float32)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / norm): near 1 for rows isolated at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, path in self.trees:
            at = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                right = x[rows, feature[at]] >= cut[at]
                at = child[at, right.astype(np.int8)]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def calibrate(anomaly: np.ndarray, good: np.ndarray) -> float:
    """The score that rejects most bad rows while keeping KEEP_GOOD of the good ones, and more where that costs nothing.

    Among equal choices it is the middle of the gap above the good rows that stay.
    """
    g = np.sort(anomaly[good])
    floor = g[min(len(g) - 1, math.ceil(KEEP_GOOD * len(g)))]
    above = np.sort(np.concatenate([anomaly[~good & (anomaly > floor)], [1.0]]))
    return float((g[g < above[0]].max(initial=floor) + above[0]) / 2)


def labelled_stats(docs: DataFrame, known: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, q, words, repeats, x) for each of known (id, q) that has a text; statistics are taken where the texts lie, and only they are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(known, "id"))  # of a fixed size
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    hashes = WordHashes()

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                b = b.filter(in_filter(shared.value, b.column(0)))
                both = [rule_stats(t, hashes) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([a[0] for a, _ in both], pa.int64()), pa.array([a[4] for a, _ in both], pa.int64()), pa.array([x for _, x in both], pa.list_(pa.float64()))], ["id", "words", "repeats", "x"])

    stats = in_batches(rows.select(filter_place(F.col("id")).alias("at"), "id", "text"), run, "id bigint, words bigint, repeats bigint, x array<double>", hashes)
    # one row of an id
    return stats.join(known.hint("merge"), "id").groupBy("id", "q").agg(F.min(F.struct("words", "repeats", "x")).alias("s")).select("id", "q", "s.*")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", quality: str = "quality") -> tuple[Forest | None, float]:
    """Forest and threshold from the labelled rows: all good ones count in each tree, and all in the threshold."""
    known = labels.where(F.col(quality).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(quality).cast("int").alias("q"))
    once = labelled_stats(docs, known.distinct(), text, id_col)
    rest = checkpointed(once.where(~base_failed(F.col("words"), F.col("repeats"))).select("id", F.col("q") == 1, "x").toDF("id", "good", "x"))
    if len(rest.select("good").distinct().collect()) < 2:
        return None, 1.0
    forest = grown(rest.where("good").select("x"))
    arrow = pa.schema([("good", pa.bool_()), ("anomaly", pa.float64())])
    scored = map_batches(rest.select("good", "x"), lambda c: {"good": c["good"], "anomaly": forest.anomaly(np.array(c["x"]))}, "good boolean, anomaly double", arrow)
    return forest, threshold_of(checkpointed(scored))


def grown(good: DataFrame) -> Forest:
    """The forest over all rows (x): they are counted in each task, and the sums, of fixed size at most, come to the driver."""
    shared = good.sparkSession.sparkContext.broadcast(splits())

    def run(batches):
        total = np.zeros(TREES << DEPTH, np.int64)
        for b in batches:
            total += leaf_counts(b.column(0).flatten().to_numpy().reshape(-1, len(FEATURES)), *shared.value).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["leaf", "n"])

    got = in_batches(good, run, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TREES << DEPTH, np.int64)
    counts[got["leaf"].to_numpy()] = got["n"].to_numpy()
    return Forest(None, counts=counts.reshape(TREES, -1))


def threshold_of(scored: DataFrame) -> float:
    """calibrate over all rows (good, anomaly), by a range partitioning and aggregates."""
    good = scored.where("good").select("anomaly")
    n = good.count()
    at = min(n - 1, math.ceil(KEEP_GOOD * n))
    floor = ranked(good, [F.col("anomaly")]).where(F.col("rn") == at + 1).first().anomaly
    above = min(1.0, scored.where(~F.col("good") & (F.col("anomaly") > floor)).agg(F.coalesce(F.min("anomaly"), F.lit(1.0))).first()[0])
    below = good.where(F.col("anomaly") < above).agg(F.max("anomaly")).first()[0]
    return (max(floor, floor if below is None else below) + above) / 2


def judge(texts: list[str | None], hashes: WordHashes, forest: Forest | None, threshold: float) -> dict[str, np.ndarray]:
    both = [rule_stats(t, hashes) for t in texts]
    out = {n: np.array([a[i] for a, _ in both], np.int64) for i, n in enumerate(STATS)}
    out["base_failed"] = base_failed(out["n_words"], out["n_repeat_words"])
    out["anomaly"] = forest.anomaly(np.array([b for _, b in both])) if forest else np.zeros(len(both))
    out["kept"] = ~out["base_failed"] & (out["anomaly"] < threshold)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, rule statistics, base_failed, anomaly and kept."""
    forest, threshold = fit(docs, labels, text, id_col)
    hashes = WordHashes()
    arrow = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in STATS), ("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())])
    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in STATS) + ", base_failed boolean, anomaly double, kept boolean"
    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), lambda c: {"doc_id": c["doc_id"]} | judge(c["text"], hashes, forest, threshold), schema, arrow, hashes)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that the quality rules keep; no shuffle."""
    forest, threshold = fit(docs, labels, text, id_col)
    hashes = WordHashes()
    at = docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                yield b.filter(pa.array(judge(b.column(at).to_pylist(), hashes, forest, threshold)["kept"]))

    # columns go by place, as any name may stand in a table
    placed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return in_batches(placed, run, placed.schema, hashes).toDF(*docs.columns)
