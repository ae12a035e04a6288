"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words that one Python worker keeps hashed; later ones are hashed each time.
CACHE_WORDS = 300_000

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder of checkpoints, set from spark.checkpoint.dir.

    Where that is unset, a local session gets a default and a cluster an error:
    a machine's own folder would be lost with the machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the folder of spark.checkpoint.dir."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints as a path that tasks can open files in; it has to be mounted on all machines."""
    at = urlparse(_checkpoint_folder(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"files that are mapped into memory need a mounted spark.checkpoint.dir, not {at.scheme}:")
    return unquote(at.path)


def give_back() -> None:
    """Return a Python worker's freed memory to the system: idle workers stay alive beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def tidy(run: Callable, *caches) -> Callable:
    """run over a task's batches; at the end its caches are emptied and memory is given back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c.clear()
            give_back()

    return wrapped


#: Bytes of an Arrow batch between the JVM and Python, where the session leaves Spark's default.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable, schema, *caches) -> DataFrame:
    """run over the Arrow batches of each task, with batches of bounded size and a tidy end."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES) == "67108864b":
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run, *caches), schema)


#: Characters of one slice of a batch: what a function sees at once is bounded by text, not by rows.
SLICE_CHARS = 4_000_000


def slices(b: pa.RecordBatch):
    """A batch in runs of rows of about SLICE_CHARS bytes in all columns; one row at least."""
    size = max(1, b.num_rows * SLICE_CHARS // max(b.nbytes, 1))
    for at in range(0, b.num_rows, size):
        yield b.slice(at, size)


def map_batches(df: DataFrame, f: Callable[[dict[str, list]], dict[str, object]], schema: str, arrow: pa.Schema, *caches) -> DataFrame:
    """Run f over slices of Arrow batches; f takes and gives columns by name. Caches are emptied after each task."""

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                out = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n).type) for n, x in ((n, out[n]) for n in arrow.names)], schema=arrow)

    return in_batches(df, run, schema, *caches)


def hashed_rows(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most limit rows, those of the least hash of keys[0] (ties by all keys), without a global sort.

    A threshold on the hash, set from the row count, first leaves about twice
    as many rows as are wanted whatever the table's size, so the exact cut sees
    a bounded number. Only where few keys repeat so often that the threshold
    leaves too few rows are all of them sorted.
    """
    n = rows.count()
    h = F.shiftrightunsigned(F.xxhash64(keys[0]), 1)
    share = (2 * limit + 6 * (2 * limit) ** 0.5) / max(n, 1)
    few = rows.where(h < int(share * (1 << 63))) if share < 1 else rows
    if share < 1 and few.count() < limit:
        few = rows
    return few.orderBy(h, *keys).limit(limit)


#: Bits of the filter by which documents that no later step asks for are left out early; false hits cost time only.
FILTER_BITS = 1 << 25


def filter_place(key: Column) -> Column:
    """The bit of a key."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, col: str, place: Callable[[Column], Column] = filter_place) -> np.ndarray:
    """A bit for each hashed id; FILTER_BITS bits at most come to the driver."""
    at = place(F.col(col)) + 1  # the bitmap functions count from 1
    parts = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_filter(bits: np.ndarray, places: pa.Array) -> pa.Array:
    at = places.to_numpy(zero_copy_only=False)
    return pa.array(((bits[at // 8] >> (at % 8).astype(np.uint8)) & 1).astype(bool))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the first CACHE_WORDS distinct ones."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.array([chr(b) in " \t\n\x0b\x0c\r" for b in range(256)])
#: Bytes whose words are hashed at once.
_CHUNK = 1 << 20


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in one line, and where each text's words end in it.

    Words are found and hashed on whole arrays, in chunks, so that a very long
    text takes no more memory at once.
    """
    line = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    space = _SPACE[line]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(line) else np.zeros(0, np.int64)
    out = np.zeros(len(starts), np.uint64)
    power = np.ones(1, np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _CHUNK)))
        a, b = starts[lo], starts[hi] if hi < len(starts) else len(line)
        first = starts[lo:hi] - a
        size = np.diff(first, append=b - a)
        if size.max() > len(power):
            power = np.cumprod(np.full(int(size.max()), _PRIME), dtype=np.uint64)
        code = line[a:b].astype(np.uint64) + np.uint64(1)
        code[space[a:b]] = 0
        with np.errstate(over="ignore"):
            code *= power[np.arange(b - a) - np.repeat(first, size)]
            h = np.add.reduceat(code, first)
            h = (h ^ (h >> np.uint64(31))) * _PRIME
            out[lo:hi] = (h ^ (h >> np.uint64(29))) * _PRIME
        lo = hi
    return out, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z, and only A-Z, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for i in range(k):
                out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return out


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def runs_by_size(texts: list[str | None], chars: int = 2_000_000):
    """Slices of texts of about so many characters, so that word lists stay small whatever the batch."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]
