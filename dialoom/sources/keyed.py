"""A keyed table of rows by bucket of their key: an upsert rewrites the buckets it touches, a lookup reads one.

A bucket's rows lie in one folder for each version of it. A small manifest says
which version of each bucket counts; it is replaced by a rename when all new
folders are whole, so a reader sees a write wholly or not at all, and a write
that fails leaves what was there. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources.commitlog import _opened
from dialoom.sources.storage import append_first_wins, checkpointed, upsert, without_keys

_MANIFEST = "manifest.json"


class KeyedTable:
    """The table at a path; created with the schema, key and number of buckets that it then keeps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        store, at = _opened(path)
        with store.open_input_stream(f"{at}/{_MANIFEST}") as s:
            said = json.loads(s.read())
        self.key, self.schema, self.buckets = said["key"], said["schema"], said["buckets"]
        self.versions: dict[str, str] = said["versions"]

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> KeyedTable:
        _write_manifest(path, {"key": key, "schema": schema, "buckets": buckets, "versions": {}})
        return KeyedTable(spark, path)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("string")

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """All rows, or those of the buckets; only the folders that count are listed."""
        wanted = [f"{self.path}/bucket={b}/version={v}" for b, v in sorted(self.versions.items()) if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*wanted)

    def lookup(self, value) -> DataFrame:
        """The rows of a key; FileNotFoundError if there are none. One bucket is read."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(value))).first()[0]
        got = self.read([bucket]).where(F.col(self.key) == F.lit(value))
        if got.isEmpty():
            raise FileNotFoundError(f"{self.key} {value!r}")
        return got

    def _changed(self, rows: DataFrame, change) -> list[str]:
        """change(existing rows of the touched buckets, rows), written as their new versions; the touched buckets."""
        rows = checkpointed(rows)  # it may read this very table
        touched = sorted(r[0] for r in rows.select(self._bucket(F.col(self.key))).distinct().collect())
        if not touched:
            return []
        version = uuid.uuid4().hex
        new = change(self.read(touched), rows).withColumn("bucket", self._bucket(F.col(self.key)))
        new.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/new-{version}")
        store, at = _opened(self.path)
        from pyarrow import fs

        there = {f.base_name.removeprefix("bucket=") for f in store.get_file_info(fs.FileSelector(f"{at}/new-{version}")) if f.base_name.startswith("bucket=")}
        versions = {b: v for b, v in self.versions.items() if b not in touched}
        for b in there:
            store.create_dir(f"{at}/bucket={b}", recursive=True)
            store.move(f"{at}/new-{version}/bucket={b}", f"{at}/bucket={b}/version={version}")
            versions[b] = version
        _write_manifest(self.path, {"key": self.key, "schema": self.schema, "buckets": self.buckets, "versions": versions})
        self.versions = versions
        return touched

    def upsert(self, rows: DataFrame) -> list[str]:
        """Rows replace those of the same key."""
        return self._changed(rows, lambda old, new: upsert(old, new, self.key))

    def add_new(self, rows: DataFrame) -> list[str]:
        """Rows of keys that are not there yet, the first of each."""
        return self._changed(rows, lambda old, new: append_first_wins(old, new, self.key))

    def delete(self, keys: DataFrame) -> list[str]:
        return self._changed(keys.select(self.key), lambda old, gone: without_keys(old, gone, self.key))

    def vacuum(self) -> int:
        """Remove the versions that no longer count, for which no reader may be under way; how many."""
        from pyarrow import fs

        store, at = _opened(self.path)
        n = 0
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.base_name.startswith("new-"):
                store.delete_dir(f.path)
            elif f.base_name.startswith("bucket="):
                for v in store.get_file_info(fs.FileSelector(f.path)):
                    if v.base_name != f"version={self.versions.get(f.base_name.removeprefix('bucket='))}":
                        store.delete_dir(v.path)
                        n += 1
        return n


def _write_manifest(path: str, said: dict) -> None:
    store, at = _opened(path)
    store.create_dir(at, recursive=True)
    part = f"{at}/{_MANIFEST}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(said).encode())
    store.move(part, f"{at}/{_MANIFEST}")
