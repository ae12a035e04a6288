"""Cross-tokenizer alignment by packed pair keys.

Two tokenizers read the same bytes; offsets where tokens of both end cut them
into groups, and overlapping tokens are linked. Each link is an int64 key, B's
id above A's. One pass tokenises and keeps, for each run of documents, their
groups, its distinct keys and its links as places among these. A task adds its
keys up with np.unique; the partial counts are sorted globally by range and runs
of equal keys summed, each range written as a shard of keys and counts in the
shared checkpoint folder; then the shards are mapped into memory and each run's
keys found by searchsorted.

Both tokenizers begin a token at a single space between two other characters,
so a text is the sequence of its units, cut there, and each distinct unit of a
task is tokenised and aligned once. That B's pieces never go across such a
place is read from its vocabulary; otherwise a text is one unit. A's merges run
in their own library, by the ids of the given file, which must follow its
merges.

Counts are over all rows, repeated ones too. Shards are written under a name of
the attempt and renamed when whole, so a lost executor leaves none by halves.
The driver sees one row per shard and the highest count of each B id, at most
one per entry of B's vocabulary.

Defined results: a null or empty text, and one whose bytes a tokenizer does not
give back, has no tokens: zeros and an empty string; a null id stays null;
repeated rows count and return each; an empty table gives an empty one. Only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import checkpointed, in_batches, shared_folder, slices

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bits of a key that hold A's id.
A_BITS = 32
#: Distinct units, and links of them, that a task keeps; beyond either it starts anew.
CACHE_UNITS, CACHE_LINKS = 500_000, 8_000_000
#: Characters of texts that are taken at once.
RUN_CHARS = 2_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Table:
    """The bytes of a vocabulary's tokens, end to end."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens) + 1
        self.sizes = np.zeros(n, np.int64)
        for i, t in tokens.items():
            self.sizes[i] = len(t)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(n)), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        to = np.cumsum(sizes)
        return self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.begins[ids] - to + sizes, sizes)]


class Tokenizers:
    """A and B with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            said = json.load(f)
        # printable Latin-1 is written as itself and the other bytes from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
        vocab, merges = said["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        made = [vocab[x + y] for x, y in merges]
        if said["pre_tokenizer"]["type"] != "ByteLevel" or said["normalizer"] or any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError(f"{a_path} is no byte-level vocabulary whose ids follow its merges")
        special = {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_table = Table({i: t for t, i in ranks.items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = Table({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)})
        self.by_units = not any(re.search("[^▁]▁", p) for p in pieces)
        # each id as text with what follows it: A's within a group and at its end, then B's
        self.words = [f"{i}{end}" for n, ends in ((len(self.a_table.sizes), ",|"), (len(pieces), ",;")) for end in ends for i in range(n)]

    def units(self, text: str) -> list[str]:
        """The text in units, without the space before each."""
        return _CUT.split(text) if self.by_units else [text]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values."""
    total = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Aligned:
    """The groups and links of a space and each of some units, on whole arrays.

    rows: n_a, n_b, groups, links, and 1 where the bytes do not come back (and
    all else is 0); keys of all links by unit; the groups as text, each with its
    semicolon.
    """

    def __init__(self, t: Tokenizers, units: list[str]):
        raw = [(" " + u).encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        a, n_a = _flat([t.a.encode_ordinary(" " + u) for u in units])
        b, n_b = _flat(t.b.encode(units, num_threads=1))
        good = (_sums(t.a_table.sizes[a], n_a) == size) & (_sums(t.b_table.sizes[b], n_b) == size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        whole = np.frombuffer(b"".join(x for x, g in zip(raw, good.tolist()) if g), np.uint8)
        same = _sums((t.a_table.joined(a) == whole) & (t.b_table.joined(b) == whole), size[good]) == size[good]
        if not same.all():
            a, b = a[np.repeat(same, n_a[good])], b[np.repeat(same, n_b[good])]
            good[np.flatnonzero(good)[~same]] = False
        n_a, n_b, size = n_a * good, n_b * good, size * good
        # each end of a token of either closes one overlap, and an end of both a group
        a_end, b_end, unit_end = np.cumsum(t.a_table.sizes[a]), np.cumsum(t.b_table.sizes[b]), np.cumsum(size)
        ends = np.union1d(a_end, b_end)
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        self.keys = b[at_b] << A_BITS | a[at_a]
        counted = lambda x: np.diff(np.searchsorted(x, unit_end, "right"), prepend=0)
        self.rows = np.column_stack([n_a, n_b, counted(cuts), counted(ends), ~good]).astype(np.int64)
        self.texts = self._texts(t, a, b, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), n_a + n_b)

    @staticmethod
    def _texts(t: Tokenizers, a, b, a_group, b_group, sizes) -> list[str]:
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        n = len(t.a_table.sizes)
        words = np.concatenate([a + n * last(a_group), 2 * n + b + len(t.b_table.sizes) * last(b_group)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        said = list(map(t.words.__getitem__, words[order].tolist()))
        ends = np.cumsum(sizes).tolist()
        return ["".join(said[lo:hi]) for lo, hi in zip([0, *ends], ends)]


class Units:
    """The distinct units of a task by number, with their alignments end to end."""

    def __init__(self, tokenizers: Tokenizers, most: int):
        self.tokenizers, self.most = tokenizers, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.rows = np.zeros((0, 5), np.int64)
        self.keys = np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.index) > self.most or len(self.keys) > CACHE_LINKS

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The unit numbers of all texts in one line, and where each text's begin; new units are aligned.

        A text is a unit at least, so every text has a beginning of its own.
        """
        parts = list(map(self.tokenizers.units, texts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        index, n = self.index, len(self.index)
        flat = list(itertools.chain.from_iterable(parts))
        new = [u for u in dict.fromkeys(flat) if u not in index]
        if new:
            index.update(zip(new, range(n, n + len(new))))
            x = Aligned(self.tokenizers, new)
            self.rows = np.concatenate([self.rows, x.rows])
            self.keys = np.concatenate([self.keys, x.keys])
            self.texts += x.texts
        return np.fromiter(map(index.__getitem__, flat), np.int64, len(flat)), np.cumsum(sizes) - sizes


def _runs(ids: list, texts: list[str | None]):
    """(ids, texts) in runs of bounded size."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= RUN_CHARS or i - lo > RUN_CHARS // 100:
            yield ids[lo : i + 1], texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


_COUNTED = ("n_a", "n_b", "n_groups", "n_links")
_RUN = pa.schema([("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _COUNTED], ("groups", pa.list_(pa.string())), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("links", pa.binary())])
_RUN_DDL = "doc_id array<bigint>, " + "".join(f"{c} array<bigint>, " for c in _COUNTED) + "groups array<string>, keys array<bigint>, times array<bigint>, links binary"


def _aligned_run(units: Units, ids: list, texts: list[str | None], hashed: bool) -> list:
    """The values of _RUN for some texts: links are places among the run's distinct keys, 16 bits each if they are few."""
    rows, groups = np.zeros((len(texts), 5), np.int64), [""] * len(texts)
    at = [i for i, t in enumerate(texts) if t]
    keys = links = np.zeros(0, np.int64)
    times = keys
    if at:
        k, begins = units.numbers([texts[i] for i in at])
        of_text = np.add.reduceat(units.rows[k], begins)
        broken = of_text[:, 4] > 0
        rows[at] = of_text * ~broken[:, None]
        said = list(map(units.texts.__getitem__, k.tolist()))
        for i, lo, hi, lost in zip(at, begins.tolist(), np.append(begins[1:], len(k)).tolist(), broken.tolist(), strict=True):
            if not lost:
                joined = "".join(said[lo:hi])[:-1]
                groups[i] = hashlib.sha256(joined.encode()).hexdigest() if hashed else joined
        k = k[~np.repeat(broken, np.diff(begins, append=len(k)))]
        n = units.rows[k, 3]
        to = np.cumsum(n)
        if len(to) and to[-1]:
            first = np.cumsum(units.rows[:, 3]) - units.rows[:, 3]
            keys, links, times = np.unique(units.keys[np.arange(to[-1]) + np.repeat(first[k] - to + n, n)], return_inverse=True, return_counts=True)
    return [ids, *[rows[:, c] for c in range(4)], groups, keys, times, links.astype(_place(len(keys))).tobytes()]


def _place(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def aligned_runs(docs: DataFrame, text: str, id_col: str, a_path: str, b_path: str, hashed: bool, cache_units: int) -> DataFrame:
    """A row for each run of documents: their groups and counts, and their links by the run's distinct keys."""

    def run(batches):
        units = Units(Tokenizers(a_path, b_path), cache_units)
        for whole in batches:
            for b in slices(whole):
                for ids, texts in _runs(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if units.full:
                        units.clear()
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_aligned_run(units, ids, texts, hashed), _RUN)], schema=_RUN)
        units.clear()

    return in_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, _RUN_DDL)


def partial_counts(runs: DataFrame) -> DataFrame:
    """(key, n): each task's links, added up."""

    def run(batches):
        keys = n = np.zeros(0, np.int64)
        for b in batches:
            new, times = (b.column(c).flatten().to_numpy() for c in (0, 1))
            keys, of = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, of, np.concatenate([n, times]))
            n = total
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["key", "n"])

    return in_batches(runs.select("keys", "times"), run, "key bigint, n bigint")


def write_shards(counts: DataFrame, folder: str) -> tuple[list[tuple[str, int, int]], dict[int, int]]:
    """Sort all partial counts by key, sum runs and write a shard per range.

    Returns the shards (name, first key, last key) by key and the highest count of each B id.
    """
    ranged = counts.repartitionByRange("key").sortWithinPartitions("key")

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        name, mine = f"{folder}/{task.partitionId():08d}", f".{task.taskAttemptId()}-{uuid.uuid4().hex}"
        best: dict[int, int] = {}
        first = last = None

        def put(keys, n):
            nonlocal first, last
            first = int(keys[0]) if first is None else first
            last = int(keys[-1])
            keys.tofile(key_file)
            n.tofile(count_file)
            b = keys >> A_BITS
            starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            for i, m in zip(b[starts].tolist(), np.maximum.reduceat(n, starts).tolist(), strict=True):
                best[i] = max(best.get(i, 0), m)

        try:
            with open(name + ".keys" + mine, "wb") as key_file, open(name + ".counts" + mine, "wb") as count_file:
                held_key, held = None, 0  # the run at the end of a batch may go on in the next
                for x in batches:
                    if not x.num_rows:
                        continue
                    keys, n = x.column(0).to_numpy(), x.column(1).to_numpy()
                    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    keys, n = keys[starts], np.add.reduceat(n, starts)
                    if held_key == keys[0]:
                        n[0] += held
                    elif held_key is not None:
                        put(np.array([held_key], np.int64), np.array([held], np.int64))
                    held_key, held = keys[-1], n[-1]
                    if len(keys) > 1:
                        put(keys[:-1], n[:-1])
                if held_key is not None:
                    put(np.array([held_key], np.int64), np.array([held], np.int64))
            for kind in (".keys", ".counts"):
                if first is None:
                    os.remove(name + kind + mine)
                else:
                    os.replace(name + kind + mine, name + kind)
        except BaseException:
            for kind in (".keys", ".counts"):
                if os.path.exists(name + kind + mine):
                    os.remove(name + kind + mine)
            raise
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([last]), pa.array([list(best)], pa.list_(pa.int64())), pa.array([list(best.values())], pa.list_(pa.int64()))], ["name", "first", "last", "b", "most"])

    best: dict[int, int] = {}
    shards = []
    for r in in_batches(ranged, run, "name string, first bigint, last bigint, b array<bigint>, most array<bigint>").collect():
        shards.append((r.name, r.first, r.last))
        for b, n in zip(r.b, r.most, strict=True):
            best[b] = max(best.get(b, 0), n)
    return sorted(shards, key=lambda s: s[1]), best


class Counts:
    """Corpus-wide counts of keys, from shards that are mapped into memory."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.names = [s[0] for s in shards]
        self.firsts = np.array([s[1] for s in shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for one that only texts without tokens hold."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        if not self.names:
            return out[back]
        shard = np.maximum(np.searchsorted(self.firsts, keys, "right") - 1, 0)
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(keys)]):
            s = int(shard[lo])
            if s not in self.open:
                self.open[s] = tuple(np.memmap(self.names[s] + kind, np.int64, "r") for kind in (".keys", ".counts"))
            mine, n = self.open[s]
            at = np.minimum(np.searchsorted(mine, keys[lo:hi]), len(mine) - 1)
            out[lo:hi] = np.where(mine[at] == keys[lo:hi], n[at], 0)
        return out[back]


def pair_counts(shards: list[tuple[str, int, int]]) -> dict[tuple[int, int], int]:
    """All counts of small shards, for tests and looking around."""
    return {(int(k) & ((1 << A_BITS) - 1), int(k) >> A_BITS): int(n) for name, *_ in shards for k, n in zip(np.fromfile(name + ".keys", np.int64), np.fromfile(name + ".counts", np.int64))}


def alignments(docs: DataFrame, text: str = "text", id_col: str = "doc_id", a_path: str | None = None, b_path: str | None = None, hashed: bool = False, cache_units: int = CACHE_UNITS) -> DataFrame:
    """Each document's groups as text and its counts; hashed gives groups_sha256 in place of groups."""
    runs = checkpointed(aligned_runs(docs, text, id_col, a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE), hashed, cache_units))
    shards, best = write_shards(partial_counts(runs), f"{shared_folder(docs.sparkSession)}/pairs-{uuid.uuid4().hex}")
    most = np.zeros(max(best, default=0) + 1, np.int64)
    most[list(best)] = list(best.values())
    name = "groups_sha256" if hashed else "groups"
    out = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*_COUNTED, "n_best", "count_sum")], (name, pa.string())])

    def run(batches):
        counts = Counts(shards)
        for b in batches:
            for r in b.to_pylist():
                keys, sizes = np.array(r["keys"], np.int64), np.array(r["n_links"], np.int64)
                n = counts.of(keys)
                best = most[keys >> A_BITS] == n
                links = np.frombuffer(r["links"], _place(len(keys)))
                sums = _sums(best[links], sizes), _sums(n[links], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([r["doc_id"], *[r[c] for c in _COUNTED], *sums, r["groups"]], out)], schema=out)

    return in_batches(runs, run, "doc_id bigint, " + "".join(f"{c} bigint, " for c in (*_COUNTED, "n_best", "count_sum")) + f"{name} string")
