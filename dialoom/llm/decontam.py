"""Benchmark decontamination by spaced-seed hashing.

A mask is a window of tokens of which some positions are ignored. Windows of
the benchmark and of the documents are hashed under every mask; equal hashes
join, and around each hit document and item are compared token by token, so a
passage with substituted words is still found. The masks leave no gap: whatever
words of a passage are substituted, as long as SHARE of them are equal, at least
one placing of one mask has only equal words.

The document side is filtered by a bitmap that grows with the benchmark up to
a limit and, where the benchmark is small enough, by its sorted hashes; all
windows that pass are shuffled. A benchmark beyond the limit fills the bitmap
and shuffles more, with the same result.

Defined results: a null or empty text or item never matches; items of fewer
than MIN_WORDS words never match, and items of fewer than OVERLAP words count
as a whole; repeated rows of a document give one row, and so do repeated ids
with unlike texts (the best stretch of any); rows with a null id are told
apart by their texts and reported under a null id; rows of an item with a null
id are left out, and repeated item ids count as one item in several versions;
empty tables give an empty one. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import ascii_lower, checkpointed, filter_place, id_filter, in_batches, in_filter, map_batches, slices, word_hashes

#: 1: the token counts; 0: it may be anything.
MASKS = ("1111011", "110100010011", "110101011", "1011000111")
#: For items of fewer than OVERLAP words, by their number of words.
SHORT_MASKS = {5: ("1111", "10111", "11011", "11101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("1111",), 9: ("1111",), 10: ("10111", "1111"), 11: ("10111",), 12: ("1111",)}
MIN_WORDS = 5
#: An aligned stretch of so many tokens (or the whole item), with so large a share equal, is contamination.
OVERLAP = 13
SHARE = 0.8
#: Tokens of context on each side that go along with a hit; stretches of longer items are measured on the whole texts.
CONTEXT = 64
#: The bitmap has BITS_PER_SEED bits for each hash, within these sizes.
FILTER_BITS, MOST_BITS = 1 << 22, 1 << 29
BITS_PER_SEED = 16
#: Benchmark hashes that are sent along to test exactly at most.
EXACT_HASHES = 1_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = b".,;:!?\"'()[]"


def _raw(text: str | None) -> bytes:
    return ascii_lower(text or "").translate(None, _PUNCTUATION)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, common punctuation dropped."""
    return word_hashes([_raw(text)])[0]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each placing of the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2) + 1) * np.uint64(0x51ED270B))
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                out = (out ^ h[k : k + n]) * _PRIME
                out ^= out >> np.uint64(31)
    return out


def small(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def overlap(doc: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int, int, int]:
    """The best stretch on the diagonal of a hit: (equal, length, start in doc, start in item).

    An equal token counts 1 and another -2; the stretch has the largest sum. If
    that one is no contamination but another is, it is the shortest of those
    with the most equal tokens.
    """
    d = p - q
    lo, hi = max(0, -d), min(len(item), len(doc) - d)
    same = item[lo:hi] == doc[lo + d : hi + d]
    s = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(s)
    end = int(np.argmax(s - low))
    start = int(np.argmin(s[: end + 1]))
    need = min(OVERLAP, len(item))
    if len(same) >= need and not contaminated(int(same[start:end].sum()), end - start, len(item)):
        e = np.concatenate([[0], np.cumsum(same)])
        share = np.round(e - SHARE * np.arange(len(e)), 6)  # between two places it rises where so many are equal
        low = np.minimum.accumulate(share)
        j = np.arange(need, len(e))
        i = np.searchsorted(-low, -share[j], "left")  # the first place no higher: most equal tokens up to j
        j, i = j[i <= j - need], i[i <= j - need]
        if len(j):
            i = np.minimum(np.searchsorted(e, e[i], "right") - 1, j - need)  # without unequal tokens ahead
            k = np.lexsort((i, j - i, e[i] - e[j]))[0]
            start, end = int(i[k]), int(j[k])
    return int(same[start:end].sum()), end - start, lo + d + start, lo + start


def contaminated(equal: int, length: int, n_item: int) -> bool:
    return length >= min(OVERLAP, n_item) and n_item >= MIN_WORDS and equal >= SHARE * length - 1e-9


def item_seeds(benchmark: DataFrame, text: str, item_col: str) -> tuple[DataFrame, DataFrame, list[str], int]:
    """(seed, item_id, q) rows, (item_id, item) rows, the masks of the lengths in use and the longest length."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    items = map_batches(
        rows,
        lambda c: {"item_id": c["item_id"], "item": [tokens(t).view(np.int64) for t in c["text"]]},
        "item_id bigint, item array<bigint>",
        pa.schema([("item_id", pa.int64()), ("item", pa.list_(pa.int64()))]),
    )
    sizes = items.select(F.least(F.size("item"), F.lit(OVERLAP)).alias("n"), F.size("item").alias("m")).where(F.col("n") >= MIN_WORDS).groupBy("n").agg(F.max("m").alias("m")).collect()
    masks = sorted({m for r in sizes for m in SHORT_MASKS.get(r.n, MASKS)})

    def seed(c):
        out: dict[str, list] = {"seed": [], "item_id": [], "q": []}
        for i, t in zip(c["item_id"], c["text"], strict=True):
            h = tokens(t)
            for m in SHORT_MASKS.get(len(h), MASKS) if len(h) >= MIN_WORDS else ():
                s = seeds(h, m)
                out["seed"] += s.view(np.int64).tolist()
                out["item_id"] += [i] * len(s)
                out["q"] += range(len(s))
        return out

    # from the texts and not from the items, so that a stage has one Python step
    seeded = map_batches(rows, seed, "seed bigint, item_id bigint, q int", pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("q", pa.int32())]))
    return seeded, items.select("item_id", F.transform("item", lambda x: F.shiftright(x, 32).cast("int")).alias("item")), masks, max((r.m for r in sizes), default=0)


def seed_filter(seeded: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """A bitmap sized by the number of seeds, and the sorted seeds if there are at most EXACT_HASHES."""
    some = [r.seed for r in seeded.select("seed").distinct().limit(EXACT_HASHES + 1).collect()]
    exact = np.sort(np.array(some, np.int64)) if len(some) <= EXACT_HASHES else None
    n = len(some) if exact is not None else seeded.agg(F.approx_count_distinct("seed")).first()[0]
    size = min(max(FILTER_BITS, 1 << (BITS_PER_SEED * n).bit_length()), MOST_BITS)
    at = F.col("seed").bitwiseAND(size - 1) + 1
    parts = seeded.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator()
    bits = np.zeros(size // 8, np.uint8)
    for r in parts:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits, exact


def keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc_id, h, text): h tells rows with a null id apart by their text."""
    doc_id = F.col(id_col).cast("bigint")
    return docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(F.col(text))).alias("h"), F.col(text).alias("text"))


def hits(docs: DataFrame, masks: list[str], bits: np.ndarray, exact: np.ndarray | None) -> DataFrame:
    """(seed, doc_id, h, t, p, at, near): windows of keyed documents that pass the filter, with the tokens around them; t numbers the texts."""
    arrow = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("t", pa.int64()), ("p", pa.int32()), ("at", pa.int64()), ("near", pa.list_(pa.int32()))])

    def run(batches):
        for whole in batches:
            yield from map(scan, slices(whole))

    def scan(texts):
        # all texts of a slice in one line; a window must end in the text in which it begins
        h, ends = word_hashes([_raw(t) for t in texts.column(2).to_pylist()])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        found = []
        for m in masks:
            s = seeds(h, m)
            b = (s & np.uint64(8 * len(bits) - 1)).astype(np.int64)
            p = np.flatnonzero((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1)
            v = s[p].view(np.int64)
            if exact is not None:
                k = np.minimum(np.searchsorted(exact, v), len(exact) - 1)
                ok = exact[k] == v if len(exact) else np.zeros(len(v), bool)
                p, v = p[ok], v[ok]
            row = np.searchsorted(ends, p, "right")
            ok = p + len(m) <= ends[row]
            p, row = p[ok], row[ok]
            found.append((v[ok], row, p, np.maximum(begins[row], p - CONTEXT), np.minimum(ends[row], p + len(m) + CONTEXT)))
        seed, row, p, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        size = hi - lo
        to = np.cumsum(size)
        near = small(h)[np.arange(to[-1] if len(to) else 0) + np.repeat(lo - to + size, size)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(near))
        return pa.RecordBatch.from_arrays([pa.array(seed), texts.column(0).take(pa.array(row)), texts.column(1).take(pa.array(row)), texts.column(3).take(pa.array(row)), pa.array(p - lo, pa.int32()), pa.array(lo - begins[row], pa.int64()), lists], schema=arrow)

    schema = "seed bigint, doc_id bigint, h bigint, t bigint, p int, at bigint, near array<int>"
    return in_batches(docs.withColumn("t", F.monotonically_increasing_id()), run, schema) if masks else docs.sparkSession.createDataFrame([], schema)


FOUND = ("doc_id", "h", "item_id", "n_equal", "n_span", "doc_start", "item_start", "n_item")


def verified(rows: DataFrame) -> DataFrame:
    """The contaminating stretches of rows (doc_id, h, item_id, t, p, q, at, near, item).

    Hits of one text (t) and one diagonal of an item that the context covers
    give the same stretch, so that of a batch's only the first is measured.
    """
    arrow = pa.schema([(n, pa.int64()) for n in FOUND])

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                item_id, t, p, q, at = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 7))
                ends = [b.column(k).offsets.to_numpy() for k in (7, 8)]
                near, item = (b.column(k).values.to_numpy() for k in (7, 8))
                n_item = np.diff(ends[1])
                key = np.stack([item_id, t, at + p - q, np.where(n_item > CONTEXT, p + at, -1)], 1)
                first = np.sort(np.unique(key, axis=0, return_index=True)[1])
                out: dict[str, list] = {n: [] for n in FOUND[3:]}
                kept = []
                for k in first.tolist():
                    equal, length, x, y = overlap(near[ends[0][k] : ends[0][k + 1]], item[ends[1][k] : ends[1][k + 1]], int(p[k]), int(q[k]))
                    if contaminated(equal, length, int(n_item[k])):
                        kept.append(k)
                        for n, v in zip(out, (equal, length, int(at[k]) + x, y, int(n_item[k])), strict=True):
                            out[n].append(v)
                rows = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), *(pa.array(v, pa.int64()) for v in out.values())], schema=arrow)

    narrow = rows.select("doc_id", "h", F.col("item_id").cast("bigint"), F.col("t").cast("bigint"), F.col("p").cast("bigint"), F.col("q").cast("bigint"), F.col("at").cast("bigint"), "near", "item")
    return in_batches(narrow, run, ", ".join(f"{n} bigint" for n in FOUND))


def measured(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stretches of items longer than the context, measured on the whole texts of the documents that hold them."""
    found = checkpointed(found)
    long = found.where(F.col("n_item") > CONTEXT).select("doc_id", "h", "item_id", (F.col("doc_start") - F.col("item_start")).alias("d")).distinct()
    key = F.coalesce("doc_id", "h")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(long.select(key.alias("key")), "key"))
    arrow = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("near", pa.list_(pa.int32()))])

    def run(batches):
        for whole in batches:
            whole = whole.filter(in_filter(bits.value, whole.column(3)))
            for b in slices(whole) if whole.num_rows else ():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([small(tokens(t)) for t in b.column(2).to_pylist()], arrow.field("near").type)], schema=arrow)

    texts = in_batches(docs.withColumn("place", filter_place(key)), run, "doc_id bigint, h bigint, near array<int>")
    texts = texts.withColumn("same", F.xxhash64("near")).dropDuplicates(["doc_id", "h", "same"]).select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "near")
    rows = long.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("h").eqNullSafe(F.col("k"))).join(items.where(F.size("item") > CONTEXT), "item_id")
    # any place of the diagonal stands for it
    rows = rows.withColumn("t", F.monotonically_increasing_id()).withColumn("p", F.greatest("d", F.lit(0))).withColumn("q", F.col("p") - F.col("d")).withColumn("at", F.lit(0))
    return found.where(F.col("n_item") <= CONTEXT).union(verified(rows.where(F.col("q") < F.size("item")).where(F.col("p") < F.size("near"))))


def _found(docs: DataFrame, benchmark: DataFrame, item_text: str, item_col: str) -> DataFrame:
    seeded, items, masks, longest = item_seeds(benchmark, item_text, item_col)
    bits, exact = seed_filter(seeded)
    # dealt out by text, so that scanning and measuring are stages of their own, with one Python worker a core each
    found = verified(hits(docs, masks, bits, exact).repartition("t").join(seeded, "seed").join(items, "item_id"))
    return measured(found, docs, items) if longest > CONTEXT else found


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, n_equal, n_span, doc_start, item_start.

    Starts and lengths count words; the row holds the best stretch.
    """
    found = _found(keyed(docs, text, id_col), benchmark, item_text, item_col)
    best = F.max(F.struct("n_equal", (-F.col("n_span")).alias("s"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    return found.groupBy("doc_id", "h", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_equal").alias("n_equal"), (-F.col("b.s")).alias("n_span"), (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, all columns, without contaminated documents."""
    bad = _found(keyed(docs, text, id_col), benchmark, item_text, item_col).select(F.col("doc_id").alias("i"), F.col("h").alias("k")).distinct()
    doc_id = F.col(f"d.`{id_col}`").cast("bigint")
    h = F.when(doc_id.isNull(), F.xxhash64(F.col(f"d.`{text}`")))
    return docs.alias("d").join(bad.alias("bad"), doc_id.eqNullSafe(F.col("bad.i")) & h.eqNullSafe(F.col("bad.k")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
