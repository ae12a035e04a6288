"""Best-fit packing: a grouping genetic algorithm over islands.

Documents become token pieces; pieces are dealt into buckets of bounded size
by hash, and each bucket is a bin-packing problem of its own. Several islands
evolve populations for each bucket: crossover injects whole well-filled bins
of one parent into the other, drops the bins that then hold duplicates, and
best-fits the displaced pieces. Between epochs each island takes the elite of
the island before it. Only lengths and ids are shuffled, never tokens.

Defined results: a null or empty text is the closing token alone; a null id
stays null; repeated rows are packed once each; an empty table gives an empty
one. Only the id and the text are read.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import checkpointed, in_batches, map_batches, runs_by_size, slices

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Pieces in a bucket, about; a bucket is solved by one task at a time.
BUCKET_PIECES = 4_000
ISLANDS = 2
POPULATION = 6
GENERATIONS = 8
#: Bins at least so full are worth injecting.
WELL_FILLED = 0.998
#: Distinct words, and ids of words, that a task keeps; beyond either it starts anew.
CACHE_WORDS, CACHE_IDS = 400_000, 2_000_000
#: Characters that are cut into words at once.
RUN_CHARS = 1_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# How the supported vocabularies normalise and split (their files say so; any other file is
# tokenised text by text), and how byte-level vocabularies write a byte: printable Latin-1 as itself, others from 256 on.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTE_LEVEL = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

#: Kinds of Latin-1 characters: space, letter, digit, mark. Texts with a character of no kind are split in a plainer way.
SPACE, LETTER, DIGIT, MARK, NO_KIND = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, NO_KIND, np.uint8)
    for b in range(256):
        c = chr(b)
        if c in " \t\n\x0b\x0c\r":
            out[b] = SPACE
        elif c.isalpha() and c not in "\xaa\xba":
            out[b] = LETTER
        elif c in "0123456789":
            out[b] = DIGIT
        elif 0x20 < b < 0x7F and c != "'":
            out[b] = MARK
    return out


KINDS = _kinds()
#: A-Z and the accented capitals in lower case.
LOWER = np.array([b + 32 if chr(b).isalpha() and chr(b).isupper() else b for b in range(256)], np.uint8)


class WordIds:
    """Token ids of texts by way of their distinct words.

    The supported splitter cuts a text at white space and between letters,
    digits and marks, so a text's ids are those of its words in order. Words
    are found and told apart on whole arrays, and only distinct new ones are
    tokenised.
    """

    def __init__(self, path: str, rules: tuple[bool, list[str]] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words, self.special = rules or self.rules(self.tokenizer)
        self.clear()

    @staticmethod
    def rules(tokenizer) -> tuple[bool, list[str]]:
        """Whether texts may be cut into words, and the strings that stand for tokens of their own."""
        said = json.loads(tokenizer.to_str())
        splitter = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        special = [t["content"] for t in said["added_tokens"]]
        by_words = (
            (said["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and len(splitter) == 2
            and splitter[0].get("pattern") == {"Regex": SPLIT}
            and splitter[1].get("type") == "ByteLevel"
            and not splitter[1].get("add_prefix_space", True)
            and not any(" " in t for t in special)
        )
        return by_words, special

    def clear(self) -> None:
        """Forget all words; the closing token is word 0."""
        self.index: dict[str | bytes, int] = {}
        self.flat = array("I", [END_ID])
        self.ends = array("q", [1])

    def _add(self, key, ids) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.index[key] = len(self.ends) - 1
        return len(self.ends) - 1

    def words(self, distinct: list[bytes]) -> np.ndarray:
        """The numbers of Latin-1 words of one kind each."""
        found = list(map(self.index.get, distinct))
        gaps = [i for i, k in enumerate(found) if k is None]
        if gaps:
            tokenize, add = self.tokenizer.model.tokenize, self._add
            wide = [i for i in gaps if not distinct[i].isascii()]
            # one pass over all of them; a line feed keeps them apart, as no word holds one
            written = b"\n".join([distinct[i] for i in wide]).decode("latin-1").encode().decode("latin-1").translate({k: v for k, v in BYTE_LEVEL.items() if k != 10}).split("\n")
            written = dict(zip(wide, written))
            for i in gaps:
                found[i] = add(distinct[i], [t.id for t in tokenize(written[i] if i in written else distinct[i].decode("ascii"))])
        return np.array(found, np.int64)

    def parts(self, text: str) -> np.ndarray:
        """The numbers of the space-separated parts of any text, or of the text as one part."""
        parts = text.replace("\n", " ").split(" ") if self.by_words else [text]
        new = list({p for p in parts if p not in self.index})
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self._add(p, e.ids)
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

    def latin(self, text: str) -> np.ndarray | None:
        """The text's Latin-1 bytes in lower case, or None if it has to be split in the plainer way."""
        if not self.by_words or any(s in text for s in self.special):
            return None
        try:
            raw = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return None
        return None if (KINDS[raw] == NO_KIND).any() else LOWER[raw]

    def ids(self, texts: list[str | None]):
        """The little-endian id bytes of each text, in order."""
        return (x[:-1].astype("<u4").tobytes() for x in self.closed(texts))

    def closed(self, texts: list[str | None]):
        """The ids of each text with the closing token, in order."""
        for run in runs_by_size(texts, RUN_CHARS):
            if len(self.index) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
                self.clear()
            raws = [self.latin(t or "") for t in run]
            numbers = self._numbers([r for r in raws if r is not None])
            known = [next(numbers) if r is not None else np.append(self.parts(t or ""), 0) for t, r in zip(run, raws, strict=True)]
            k = np.concatenate(known)
            ends = np.frombuffer(self.ends, np.int64)
            sizes = np.diff(ends, prepend=0)[k]
            to = np.cumsum(sizes)
            at = np.arange(to[-1]) + np.repeat(ends[k] - to, sizes)
            ids = np.frombuffer(self.flat, np.uint32)[at]
            del ends  # the arrays may grow again only when nothing looks at them
            stop = to[np.cumsum([len(x) for x in known]) - 1]
            yield from np.split(ids, stop[:-1])

    def _numbers(self, raws: list[np.ndarray]):
        """Word numbers of each of these texts with the closing one; all are cut into words at once."""
        if not raws:
            return
        sizes = np.array([len(r) for r in raws]) + 1
        line = np.full(sizes.sum(), 32, np.uint8)  # a space after each text
        stops = np.cumsum(sizes)
        for r, stop in zip(raws, stops, strict=True):
            line[stop - 1 - len(r) : stop - 1] = r
        kind = KINDS[line]
        begins = np.flatnonzero((kind != SPACE) & ((kind != np.concatenate([[SPACE], kind[:-1]])) | (kind == DIGIT)))
        solid = kind != SPACE
        before = np.cumsum(solid, dtype=np.int32) - solid
        offsets = np.append(before[begins], int(solid.sum())).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(line[solid])]).dictionary_encode()
        k = self.words(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(begins) else np.zeros(0, np.int64)
        cuts = np.searchsorted(begins, stops)
        lo = 0
        for hi in cuts.tolist():
            yield np.append(k[lo:hi], 0)
            lo = hi


def pieces(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The token pieces of every document."""
    path = path or tokenizer_path()
    known = WordIds(path)
    rules = known.by_words, known.special  # read once, as a task need not hold the whole file's text

    def run(batches):
        words = WordIds(path, rules)
        for whole in batches:
            for b in slices(whole):
                out: dict[str, list] = {n: [] for n in PIECES_ARROW.names}
                for i, ids in zip(b.column(0).to_pylist(), words.closed(b.column(1).to_pylist()), strict=True):
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        for n, v in zip(out, (i, p, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=PIECES_ARROW)

    return in_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, PIECES)


def best_fit(lengths: list[int], items, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Place items, longest first, each where it leaves least room; opens bins as needed."""
    order = sorted(range(len(bins)), key=room.__getitem__)
    rooms = [room[b] for b in order]
    for i in sorted(items, key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            b, left = len(bins), capacity - n
            bins.append([i])
            room.append(left)
        else:
            b, left = order[at], rooms[at] - n
            del order[at], rooms[at]
            bins[b].append(i)
            room[b] = left
        if left:
            to = bisect.bisect_left(rooms, left)
            rooms.insert(to, left)
            order.insert(to, b)


class Person:
    """A packing: bins, the room left in each, and its fitness (fewer bins, then uneven filling)."""

    def __init__(self, bins: list[list[int]], room: list[int], capacity: int):
        self.bins, self.room = bins, room
        fill = 1 - np.array(room) / capacity
        self.fitness = float((fill * fill).mean() - len(bins)) if bins else 0.0

    @staticmethod
    def of(bins: list[list[int]], lengths: list[int], capacity: int) -> Person:
        return Person(bins, [capacity - sum(lengths[i] for i in b) for b in bins], capacity)

    @staticmethod
    def packed(lengths: list[int], runs, capacity: int) -> Person:
        """Best fit of one run of items after the other."""
        bins: list[list[int]] = []
        room: list[int] = []
        for items in runs:
            best_fit(lengths, items, bins, room, capacity)
        return Person(bins, room, capacity)


def cross(a: Person, b: Person, lengths: list[int], capacity: int, rng) -> Person:
    """A child of b with a random half of a's well-filled bins."""
    spare = (1 - WELL_FILLED) * capacity
    full = [k for k, r in enumerate(a.room) if r <= spare and rng.random() < 0.5]
    taken = {i for k in full for i in a.bins[k]}
    clean = [k for k in range(len(b.bins)) if taken.isdisjoint(b.bins[k])]
    # the emptiest bins are loosened as well, so that displaced pieces find new company
    clean.sort(key=b.room.__getitem__)
    clean = clean[: max(0, len(clean) - max(2, len(clean) // 20))]
    bins = [list(a.bins[k]) for k in full] + [list(b.bins[k]) for k in clean]
    room = [a.room[k] for k in full] + [b.room[k] for k in clean]
    placed = taken.union(*(b.bins[k] for k in clean))
    best_fit(lengths, [i for i in range(len(lengths)) if i not in placed], bins, room, capacity)
    return Person(bins, room, capacity)


def evolve(lengths: list[int], migrants: list[list[list[int]]], seed: int, capacity: int = CAPACITY) -> Person:
    """The elite of one island after GENERATIONS; ends as soon as the lower bound is met."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    everyone = range(len(lengths))
    people = [Person.of(m, lengths, capacity) for m in migrants] or [Person.packed(lengths, [everyone], capacity)]
    for _ in range(POPULATION - len(people)):
        if min(len(p.bins) for p in people) <= least:
            break
        order = np.argsort(-np.array(lengths) * rng.uniform(0.8, 1.2, len(lengths))).tolist()
        half = len(order) // 2
        people.append(Person.packed(lengths, [order[:half], order[half:]], capacity))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: -p.fitness)
        if len(people[0].bins) <= least:
            break
        a, b = people[int(rng.integers(min(3, len(people))))], people[int(rng.integers(len(people)))]
        people[-1] = cross(a, b, lengths, capacity, rng)
    return max(people, key=lambda p: p.fitness)


def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, x in enumerate(bins):
        for i in x:
            out[i] = b
    return out


def _bins(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat) + 1)] if flat else []
    for i, b in enumerate(flat):
        out[b].append(i)
    return out


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = checkpointed(pieces(docs, text, id_col, path, capacity))
    n_buckets = max(1, -(-cut.count() // BUCKET_PIECES))
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    # the row's place in the checkpoint deals equal rows to different buckets
    place = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_buckets))
    dealt = cut.withColumn("bucket", place).repartition(min(n_buckets, 10_000), "bucket")
    buckets = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    problem = buckets.select("bucket", F.col("items.length").alias("lengths"))

    elite = pa.schema([("bucket", pa.int64()), ("island", pa.int32()), ("score", pa.float64()), ("bins", pa.list_(pa.int32()))])
    shape = "bucket bigint, island int, score double, bins array<int>"

    def epoch(k):
        def run(cols):
            out: dict[str, list] = {n: [] for n in elite.names}
            for bucket, island, lengths, came in zip(cols["bucket"], cols["island"], cols["lengths"], cols["came"], strict=True):
                best = evolve(lengths, [_bins(f) for f in came], 1_000_003 * bucket + 101 * island + k, capacity)
                for n, v in zip(elite.names, (bucket, island, best.fitness, _flat(best.bins, len(lengths))), strict=True):
                    out[n].append(v)
            return out

        return run

    islands = problem.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    first = map_batches(islands.withColumn("came", F.array().cast("array<array<int>>")), epoch(0), shape, elite)
    # an island's elite goes to the next island, beside its own
    moved = first.select("bucket", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)).alias("island"), "bins").groupBy("bucket", "island").agg(F.collect_list("bins").alias("came"))
    second = map_batches(islands.join(moved, ["bucket", "island"]).select("bucket", "island", "lengths", "came"), epoch(1), shape, elite)
    chosen = second.groupBy("bucket").agg(F.max_by("bins", F.struct("score", "island")).alias("bins"))

    placed = buckets.join(chosen, "bucket").select("bucket", F.inline(F.arrays_zip("items", "bins"))).select("bucket", "items.*", "bins")

    before = Window.partitionBy("bucket", "bins").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("bucket") * F.lit(1 << 24) + F.col("bins")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"),
    )
