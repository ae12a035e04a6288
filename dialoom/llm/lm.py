"""LM scoring: masked pseudo-likelihood with a bidirectional window network.

A word is a token by its hash. Each token is predicted from the two words on
either side by a network trained in numpy. Its output is a tree of softmaxes,
which multiply to a proper distribution over all tokens: first the token
itself, if it is one of the most frequent, or else a group; within the group
again the token itself or the group's rest; within the rest, where a token is
too rare to tell anything of its context, its share by corpus counts. The sum
of the conditional logarithms is the score of a document.

Texts become token ids once, in a checkpointed table. Counts are taken over
all documents, and the network is trained on every place of every document,
once: documents are dealt into shards by hash, each shard trains from the
common weights, and these are averaged by the places they have seen, in two
rounds. The number of shards follows from the number of rows, so the model
does not depend on the partitions of the input. What reaches the driver is of
fixed size.

Defined results: a null or empty text has no token and scores 0; repeated rows
score alike, count each time and are trained on once; rows with a null id are
like any other; an empty table gives an empty one. Only the id and the text
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import ascii_lower, checkpointed, in_batches, slices, word_hashes

TOKEN_BITS = 22
TOKENS = 1 << TOKEN_BITS
#: The most frequent tokens are outputs of the first softmax, beside the groups.
OWN, GROUPS = 32, 32
CLASSES = OWN + GROUPS
#: The next ones are outputs of their group's softmax, whose last output is the group's rest.
MEMBERS = 128
REST = MEMBERS - 1
#: Input rows: the most frequent tokens have one each, all others share the rest by hash.
OWN_INPUT, INPUTS = 1024, 2048
PAD = INPUTS
DIM = 16
AROUND = (-2, -1, 1, 2)
BATCH = 4096
RATE = 0.2
#: Count of a token that was never seen.
ALPHA = 0.05
SEED = 3
#: Documents of a shard, about, and shards at most; the share of shards that the first round trains on.
SHARD_ROWS, SHARDS = 4096, 4096
FIRST_ROUND = 0.25
#: Tokens that are laid out at once.
RUN_TOKENS = 1 << 16
BLOCK = 4096


def token_ids(texts: list[str | None]) -> list[np.ndarray]:
    """The tokens of each text: hashes of its words with A-Z in lower case."""
    h, ends = word_hashes([ascii_lower(t or "") for t in texts])
    return np.split((h >> np.uint64(64 - TOKEN_BITS)).astype(np.int32), ends[:-1])


@dataclass
class Vocabulary:
    """The outputs of tokens in the tree, and their input rows."""

    #: Output of the first softmax and of the group's (-1: none) for each token.
    cls: np.ndarray
    slot: np.ndarray
    inp: np.ndarray
    #: Logarithm of the share in the group's rest; 0 for a token with an output of its own.
    log_rest: np.ndarray | None = None

    @staticmethod
    def ranked(top: np.ndarray) -> Vocabulary:
        """From the most frequent tokens in order; all others are dealt by their number."""
        every = np.arange(TOKENS, dtype=np.int32)
        cls, slot = (OWN + every % GROUPS).astype(np.int8), np.full(TOKENS, REST, np.int16)
        cls[top[:OWN]], slot[top[:OWN]] = np.arange(min(OWN, len(top))), -1
        named = top[OWN : OWN + GROUPS * REST]
        cls[named], slot[named] = OWN + np.arange(len(named)) % GROUPS, np.arange(len(named)) // GROUPS
        inp = (OWN_INPUT + every % (INPUTS - OWN_INPUT)).astype(np.int16)
        inp[top[:OWN_INPUT]] = np.arange(min(OWN_INPUT, len(top)))
        return Vocabulary(cls, slot, inp)

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        v = Vocabulary.ranked(frequent(counts))
        rest = np.flatnonzero(v.slot == REST)
        mass = counts[rest] + ALPHA
        group = v.cls[rest]
        v.log_rest = np.zeros(TOKENS, np.float32)
        v.log_rest[rest] = np.log(mass / np.bincount(group, mass, CLASSES)[group])
        return v


def frequent(counts: np.ndarray) -> np.ndarray:
    """The tokens with an output of their own, by frequency, ties by number."""
    n = OWN + GROUPS * REST
    some = np.flatnonzero(counts >= max(np.partition(counts, TOKENS - n)[TOKENS - n], 1))
    some = some[np.lexsort((some, -counts[some]))][:n]
    return np.concatenate([some, np.flatnonzero(counts == 0)[: n - len(some)]])


class Network:
    """Embeddings for each place around the masked one, tanh, and the tree of softmaxes."""

    def __init__(self, flat: np.ndarray | None = None):
        shapes = [(len(AROUND), INPUTS + 1, DIM), (DIM,), (DIM, CLASSES), (CLASSES,), (GROUPS, DIM, MEMBERS), (GROUPS, MEMBERS)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.random.default_rng(SEED).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = flat
        cuts = np.cumsum([0, *sizes])
        self.e, self.b, self.w, self.c, self.w2, self.c2 = (self.flat[x:y].reshape(s) for x, y, s in zip(cuts[:-1], cuts[1:], shapes, strict=True))
        self.past: dict[str, np.ndarray] = {}

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.e[0], around[0], 0, mode="clip")
        h += self.b
        for k in range(1, len(AROUND)):
            h += np.take(self.e[k], around[k], 0, mode="clip")
        return np.tanh(h, out=h)

    def _members(self, h: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
        """The outputs within the groups, of rows that are sorted by group."""
        z = np.empty((groups[-1][1].stop if groups else 0, MEMBERS), np.float32)
        for g, rows in groups:
            np.matmul(h[rows], self.w2[g], out=z[rows])
            z[rows] += self.c2[g]
        return z

    def log_outputs(self, around: np.ndarray, cls: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The logarithm of each token's output in the tree; the share in a group's rest is yet to be added."""
        h = self.hidden(around)
        z = h @ self.w
        z += self.c
        out = _log_softmax(z, cls)
        order, groups = _grouped(cls)
        out[order] += _log_softmax(self._members(h[order], groups), slot[order])
        return out

    def _move(self, name: str, at, value: np.ndarray, slope: np.ndarray, rate: float) -> None:
        if name not in self.past:
            self.past[name] = np.full(getattr(self, name).shape, 1e-8, np.float32)
        past = self.past[name] if at is None else self.past[name][at]
        past += slope * slope
        slope = rate * slope
        slope /= np.sqrt(past)
        value -= slope

    def step(self, around: np.ndarray, cls: np.ndarray, slot: np.ndarray, rate: float) -> None:
        """One update towards the outputs of a batch; steps shrink with what a weight has seen (Adagrad)."""
        h = self.hidden(around)
        n = np.float32(1 / len(cls))
        z = h @ self.w
        z += self.c
        p = _error(z, cls, n)
        back = p @ self.w.T
        self._move("w", None, self.w, h.T @ p, rate)
        self._move("c", None, self.c, p.sum(0), rate)
        order, groups = _grouped(cls)
        hg = h[order]
        p = _error(self._members(hg, groups), slot[order], n)
        back_g = np.empty_like(hg)
        slope, slope_c = np.zeros_like(self.w2), np.zeros_like(self.c2)
        for g, rows in groups:
            np.matmul(p[rows], self.w2[g].T, out=back_g[rows])
            np.matmul(hg[rows].T, p[rows], out=slope[g])
            p[rows].sum(0, out=slope_c[g])
        back[order] += back_g
        self._move("w2", None, self.w2, slope, rate)
        self._move("c2", None, self.c2, slope_c, rate)
        back *= 1 - h * h
        self._move("b", None, self.b, back.sum(0), rate)
        flat, each, at = back.ravel().astype(np.float64), np.arange(DIM), np.empty(back.shape, np.int64)
        for k in range(len(AROUND)):
            np.add((around[k] * DIM)[:, None], each, out=at)
            slope = np.bincount(at.ravel(), flat, (INPUTS + 1) * DIM).astype(np.float32).reshape(INPUTS + 1, DIM)
            self._move("e", k, self.e[k], slope, rate)


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(at)), at]
    return own - np.log(np.exp(z, out=z).sum(1))


def _error(z: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """The slope of the loss at the outputs."""
    p = np.exp(z, out=z)
    p *= scale / p.sum(1, keepdims=True)
    p[np.arange(len(at)), at] -= scale
    return p


def _grouped(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The rows of groups, sorted by group, and where in them each group lies that occurs."""
    order = np.argsort(cls.astype(np.int8), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(OWN, CLASSES + 1))
    cuts = (ends - ends[0]).tolist()
    return order[ends[0] :], [(g, slice(cuts[g], cuts[g + 1])) for g in range(GROUPS) if cuts[g] < cuts[g + 1]]


def lay(ids: list[np.ndarray], inp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of documents in one line with padding between, and the places of their tokens."""
    gap = max(AROUND)
    sizes = np.array([len(x) for x in ids], np.int64)
    line = np.full(sizes.sum() + gap * (len(ids) + 1), PAD, np.int64)
    places = np.arange(sizes.sum()) + np.repeat(gap * np.arange(1, len(ids) + 1), sizes)
    line[places] = inp[np.concatenate(ids)] if ids else 0
    return line, places


def _shard_of(doc_id: int | None, key: int, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc_id} {key}".encode()) % shards


def tokenised(docs: DataFrame, text: str, id_col: str, shards: int) -> DataFrame:
    """(doc_id, shard, key, ids): token ids of every row, brought together and sorted by shard.

    A row that the same task has seen before gets a negative shard: it is not
    trained on, and equal rows do not all come to one shard.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("key", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        seen: set[tuple] = set()
        repeats = 0
        for whole in batches:
            for b in slices(whole):
                out: dict[str, list] = {"doc_id": b.column(0).to_pylist(), "shard": [], "key": [], "ids": []}
                for i, x in zip(out["doc_id"], token_ids(b.column(1).to_pylist()), strict=True):
                    raw = x.astype("<i4").tobytes()
                    key = int.from_bytes(xxhash.xxh3_64_digest(raw), "little", signed=True)
                    if (i, key) in seen:
                        repeats += 1
                        out["shard"].append(-1 - repeats % SHARDS)
                    else:
                        seen.add((i, key))
                        out["shard"].append(_shard_of(i, key, shards))
                    out["key"].append(key)
                    out["ids"].append(raw)
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    rows = in_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, shard int, key bigint, ids binary")
    return checkpointed(rows.repartition(shards, "shard").sortWithinPartitions("shard", "key", "doc_id"))


def _ids(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<i4") for x in column]


def count_tokens(rows: DataFrame) -> np.ndarray:
    """How often each token occurs in all documents; summed in each partition first."""

    def run(batches):
        total = np.zeros(TOKENS, np.int64)
        for b in batches:
            for part in slices(b):
                total += np.bincount(np.concatenate(_ids(part.column(0))), minlength=TOKENS)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            x = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(total[x], pa.int64())], ["token", "n"])

    got = in_batches(rows.select("ids"), run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TOKENS, np.int64)
    out[got["token"].to_numpy()] = got["n"].to_numpy()
    return out


def train(rows: DataFrame, top: np.ndarray, shards: int) -> Network:
    """The network after both rounds; a round averages what its shards make of the last round's weights."""
    net = Network()
    first = max(1, round(FIRST_ROUND * shards))
    for lo, hi in ((0, first), (first, shards)):
        if lo < hi:
            net = _round(rows.where((F.col("shard") >= lo) & (F.col("shard") < hi)), top, net)
    return net


def _round(rows: DataFrame, top: np.ndarray, start: Network) -> Network:
    n_blocks = -(-len(start.flat) // BLOCK)
    known = rows.sparkSession.sparkContext.broadcast((start.flat, top))

    def learn(batches):
        flat, best = known.value
        v = Vocabulary.ranked(best)
        net, shard, last, places_seen = Network(flat.copy()), None, None, 0
        held: list[np.ndarray] = []

        def study():
            if not held:
                return 0
            ids = np.concatenate(held)
            line, places = lay(held, v.inp)
            for at in range(0, len(places), BATCH):
                p, x = places[at : at + BATCH], ids[at : at + BATCH]
                net.step(np.stack([line[p + k] for k in AROUND]), v.cls[x].astype(np.int64), v.slot[x].astype(np.int64), RATE)
            held.clear()
            return len(places)

        def weights():
            if places_seen:
                x = np.concatenate([net.flat, np.zeros(n_blocks * BLOCK - len(net.flat), np.float32)]).reshape(n_blocks, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(range(n_blocks), pa.int32()), pa.array([float(places_seen)] * n_blocks), pa.array(list(x), pa.list_(pa.float32()))], ["block", "n", "x"])

        size = 0
        for b in batches:
            for part in slices(b):
                for i, s, key, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), _ids(part.column(3)), strict=True):
                    if s != shard:
                        places_seen += study()
                        yield from weights()
                        net, shard, places_seen, size = Network(flat.copy()), s, 0, 0
                    if (i, key) != last and len(x):  # equal rows from other tasks stand beside each other
                        held.append(x.copy())
                        size += len(x)
                        if size >= RUN_TOKENS:
                            places_seen += study()
                            size = 0
                    last = (i, key)
        places_seen += study()
        yield from weights()

    def average(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = sums.setdefault(k, [0.0, np.zeros(BLOCK)])
                s[0] += n
                s[1] += n * x.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([(s / n).astype(np.float32) for n, s in sums.values()], pa.list_(pa.float32()))], ["block", "x"])

    trained = in_batches(rows.select("doc_id", "shard", "key", "ids"), learn, "block int, n double, x array<float>")
    got = in_batches(trained.repartition("block"), average, "block int, x array<float>").toArrow()
    if not got.num_rows:
        return start
    order = np.argsort(got["block"].to_numpy())
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(n_blocks, BLOCK)[order]
    return Network(x.ravel()[: len(start.flat)].copy())


def log_probs(ids: list[np.ndarray], net: Network, v: Vocabulary) -> np.ndarray:
    """The summed conditional log-probabilities of documents."""
    line, places = lay(ids, v.inp)
    flat = np.concatenate(ids)
    total = np.zeros(len(flat) + 1)
    for at in range(0, len(flat), BATCH):
        p, x = places[at : at + BATCH], flat[at : at + BATCH]
        total[at + 1 : at + 1 + len(x)] = net.log_outputs(np.stack([line[p + k] for k in AROUND]), v.cls[x].astype(np.int64), v.slot[x].astype(np.int64)) + v.log_rest[x]
    total = np.cumsum(total)
    ends = np.cumsum([len(x) for x in ids])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) for every row."""
    shards = min(max(1, -(-docs.count() // SHARD_ROWS)), SHARDS)
    rows = tokenised(docs, text, id_col, shards)
    vocabulary = Vocabulary.of(count_tokens(rows))
    top = frequent_of(vocabulary)
    net = train(rows, top, shards)
    known = docs.sparkSession.sparkContext.broadcast((net.flat, top, vocabulary.log_rest))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("mean_log_prob", pa.float64())])

    def run(batches):
        flat, best, log_rest = known.value
        v, model = Vocabulary.ranked(best), Network(flat)
        v.log_rest = log_rest
        for whole in batches:
            for b in slices(whole):
                ids = _ids(b.column(1))
                n = np.array([len(x) for x in ids])
                s = log_probs(ids, model, v)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s), pa.array(s / np.maximum(n, 1))], schema=arrow)

    return in_batches(rows.select("doc_id", "ids"), run, "doc_id bigint, n_tokens bigint, log_prob double, mean_log_prob double")


def frequent_of(v: Vocabulary) -> np.ndarray:
    """The tokens with outputs of their own, in the order that gives these outputs."""
    own = np.flatnonzero(v.slot < 0)
    named = np.flatnonzero((v.slot >= 0) & (v.slot < REST))
    return np.concatenate([own[np.argsort(v.cls[own])], named[np.lexsort((v.cls[named], v.slot[named]))]])
