"""A durable ledger of client calls: what was answered is written as it comes, read before asking, and paid once.

A call is known by its scope (a dialogue's id, or the prompt itself), its prompt
and how often that was asked in the scope before. Scopes are dealt into buckets
by a checksum, and rows are brought to tasks by bucket, so a task reads the
entries of its own buckets and no others. Every attempt of a task appends to a
file of its own in a bucket's folder; a run that lost a worker, or was stopped,
replays all that was answered and asks the rest.

Two attempts of one task that run at once do not see each other's answers; with
speculation off that does not happen.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
import zlib
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources.commitlog import _opened

#: Folders of a ledger; a task holds the entries of one at a time in memory.
BUCKETS = 256
#: Answers after which a file is closed and a new one begun: stores that keep a file only when it is closed lose no more.
ROLL = 100

ENTRY = "scope string, prompt string, attempt int, provider string, model string, answer string, input_tokens bigint, output_tokens bigint"


class Pace:
    """At most so many calls a second; a caller waits for its turn."""

    def __init__(self, rate: float | None):
        self.gap = 1 / rate if rate else 0.0
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            turn = max(now, self.next)
            self.next = turn + self.gap
        time.sleep(turn - now)


class Shelf:
    """The entries of one bucket, and a file that new ones are appended to."""

    def __init__(self, path: str, bucket: int):
        from pyarrow import fs

        store, at = _opened(path)
        self.store, self.folder = store, f"{at}/bucket={bucket}"
        self.entries: dict[tuple[str, str, int], dict] = {}
        self.lock, self.asking = threading.Lock(), defaultdict(threading.Lock)
        self.out, self.lines = None, 0
        for f in store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with store.open_input_stream(f.path) as s:
                for line in s.read().split(b"\n")[:-1]:  # a line that a crash cut off has no end
                    x = json.loads(line)
                    self.entries[x["scope"], x["prompt"], x["attempt"]] = x

    def add(self, entry: dict) -> None:
        with self.lock:
            if self.out is None:
                self.store.create_dir(self.folder, recursive=True)
                self.out = self.store.open_output_stream(f"{self.folder}/calls-{uuid.uuid4().hex}.json")
            self.out.write(json.dumps(entry).encode() + b"\n")
            self.out.flush()
            self.entries[entry["scope"], entry["prompt"], entry["attempt"]] = entry
            self.lines += 1
            if self.lines % ROLL == 0:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Paid:
    """A client within one scope: answered calls come from the shelf, others are made and put there."""

    def __init__(self, client, shelf: Shelf, pace: Pace, scope: str):
        from dialoom.operators.clients import name_of

        self.client, self.shelf, self.pace, self.scope = client, shelf, pace, scope
        self.provider, self.model = name_of(client)
        self.asked: Counter[str] = Counter()

    def generate_with_tokens(self, prompt: str) -> tuple[str, int, int]:
        key = hashlib.md5(f"{self.provider}/{self.model}\n{prompt}".encode()).hexdigest()
        attempt = self.asked[key]
        self.asked[key] += 1
        with self.shelf.lock:
            turn = self.shelf.asking[self.scope, key, attempt]
        with turn:  # equal calls under way wait for the first one's answer
            found = self.shelf.entries.get((self.scope, key, attempt))
            if found is None:
                self.pace.wait()
                if hasattr(self.client, "generate_with_tokens"):
                    answer, asked, said = self.client.generate_with_tokens(prompt)
                else:
                    answer, asked, said = self.client.generate(prompt), 0, 0
                found = dict(zip((c.split()[0] for c in ENTRY.split(", ")), (self.scope, key, attempt, self.provider, self.model, answer, asked, said), strict=True))
                self.shelf.add(found)
        return found["answer"], found["input_tokens"], found["output_tokens"]

    def generate(self, prompt: str) -> str:
        return self.generate_with_tokens(prompt)[0]


class Ledger:
    """Where the calls are kept, and the rate at which all tasks together may make them.

    The number of buckets belongs to a ledger: another one finds nothing.
    """

    def __init__(self, path: str, buckets: int = BUCKETS, rate: float | None = None):
        self.path, self.buckets, self.rate = path, buckets, rate
        self.tasks = 1

    def bucket(self, scope: Column) -> Column:
        return F.crc32(scope.cast("string").cast("binary")) % self.buckets

    def dealt(self, df: DataFrame, scope: Column) -> DataFrame:
        """The rows in tasks by bucket, in its order; each task's share of the rate follows from how many run at once."""
        self.tasks = min(self.buckets, df.sparkSession.sparkContext.defaultParallelism)
        return df.withColumn("__bucket", self.bucket(scope)).repartition(self.buckets, "__bucket").sortWithinPartitions("__bucket")

    def session(self) -> Session:
        """For one task: opens the shelves of the scopes that it asks for, one after the other."""
        return Session(self.path, self.buckets, Pace(self.rate / self.tasks if self.rate else None))

    def calls(self, spark: SparkSession) -> DataFrame:
        """Every call once, as it was paid."""
        from pyarrow import fs

        store, at = _opened(self.path)
        if not any(f.type == fs.FileType.Directory for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True))):
            return spark.createDataFrame([], ENTRY)
        rows = spark.read.schema(ENTRY + ", bucket int").option("mode", "DROPMALFORMED").json(self.path)
        return rows.drop("bucket").dropDuplicates(["scope", "prompt", "attempt"])


class Session:
    def __init__(self, path: str, buckets: int, pace: Pace):
        self.path, self.buckets, self.pace = path, buckets, pace
        self.at: int | None = None
        self.shelf: Shelf | None = None
        self.lock = threading.Lock()

    def paid(self, client, scope) -> Paid:
        scope = str(scope)
        bucket = zlib.crc32(scope.encode()) % self.buckets
        with self.lock:
            if bucket != self.at:
                # calls of the bucket before may be under way; they keep their shelf
                self.at, self.shelf = bucket, Shelf(self.path, bucket)
            return Paid(client, self.shelf, self.pace, scope)
