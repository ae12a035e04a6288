"""Scans of folders and files: input patterns, merge folders, query stores, sample lists and JSON of any shape.

Paths are resolved by Spark's file systems, so they may lie in any store it reads.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.samples import keep_first, stored_query_id
from dialoom.sources.json_items import json_items
from dialoom.sources.storage import checkpointed, is_json, query_text

INDEX = "index.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def resolve_inputs(spark: SparkSession, patterns: list[str], prefix: str = "") -> list[str]:
    """The files and folders that the patterns name, in the patterns' order and by name within one; missing ones go.

    With a prefix only names that begin with it stay.
    """
    out = []
    for p in patterns:
        at, fs = _fs(spark, p)
        found = fs.globStatus(at) or []
        out += sorted(s.getPath().toString() for s in found if s.getPath().getName().startswith(prefix))
    return out


def merge_files(spark: SparkSession, folder: str, use_index: bool = True) -> list[str]:
    """The interaction files of a folder: in its index's order if it has a readable one with paths, else all by name.

    Paths of the index that are not absolute lie in the folder.
    """
    if use_index:
        index = resolve_inputs(spark, [f"{folder}/{INDEX}"])
        rows = spark.read.text(index, wholetext=True).select(F.from_json(F.get_json_object("value", "$.interactions"), "array<struct<filepath:string>>").alias("i")).collect() if index else []
        named = [x.filepath for r in rows for x in r.i or [] if x.filepath]
        if named:
            return [p if os.path.isabs(p) or "://" in p else f"{folder}/{p}" for p in named]
    return [p for p in resolve_inputs(spark, [f"{folder}/*.json"]) if not p.endswith(f"/{INDEX}")]


def _plain(path: Column) -> Column:
    """A path without its scheme, as Spark and a caller may write it in different ways."""
    return F.regexp_replace(path, "^[a-z0-9]+:/*", "/")


def read_in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, path, body) of whole files in the listed order; missing files have a null body."""
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_ord int, path string")
    there = [p for p in paths if resolve_inputs(spark, [p])]
    if not there:
        return listed.withColumn("body", F.lit(None).cast("string"))
    bodies = spark.read.text(there, wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("__p"), F.col("value").alias("body"))
    return listed.withColumn("__p", _plain(F.col("path"))).join(bodies, "__p", "left").drop("__p")


def read_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, pos, item): the items of JSON array files one after the other, as JSON; another shape is an error."""
    rows = read_in_order(spark, paths).withColumn("items", F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"))
    bad = F.raise_error(F.concat(F.lit("no JSON array: "), "path"))
    items = F.when(F.col("items").isNull(), bad.cast("array<variant>")).otherwise(F.col("items"))
    return rows.select("file_ord", F.posexplode(items).alias("pos", "v")).select("file_ord", F.col("pos").cast("bigint").alias("pos"), F.to_json("v").alias("item"))


def read_store(spark: SparkSession, folder: str, persona: str | None = None) -> DataFrame:
    """(persona_id, pos, query_id, item): the queries of a store's files, an id for each and the first of each id.

    A file is an object with `queries` or an array; one of another shape has no
    query, and one that is no JSON is left out, as are items that are no objects.
    """
    paths = resolve_inputs(spark, [f"{folder}/{persona if persona is not None else '*'}.json"])
    schema = "persona_id string, pos bigint, query_id string, item string"
    if not paths:
        return spark.createDataFrame([], schema)
    whole = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("persona_id"), F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.queries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = whole.select("persona_id", F.posexplode(items).alias("pos", "q")).where(F.schema_of_variant("q").startswith("OBJECT")).select("persona_id", F.col("pos").cast("bigint").alias("pos"), F.to_json("q").alias("item"))
    field = lambda f: F.get_json_object("item", f"$.{f}")
    made = stored_query_id(field("source"), F.coalesce(query_text(F.col("item")), F.lit("")), field("id"), field("uid"))
    rows = rows.withColumn("query_id", F.coalesce(F.nullif(field("query_id"), F.lit("")), made))
    return keep_first(rows, ["persona_id", "query_id"], "pos").select("persona_id", "pos", "query_id", "item")


def read_any_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, pos, item, unread): the items of arrays, single objects, JSON lines and objects one after another.

    Files whose first line is a whole object are JSON lines: they are read line
    by line, and a malformed line is a row with a null item and its length as
    unread. Other files are cut at braces and followed through all of them, see
    json_items. Either way a file is read in splits, and nothing is lost
    without a word. The names of files, and no more, come to the driver, where
    Spark lists them anyway.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"), "value").where(F.trim("value") != "")
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "pos").alias("head"))
    kinds = checkpointed(first.select("path", (F.ltrim("head").startswith("{") & is_json(F.col("head"))).alias("by_line")))
    whole = is_json(F.col("value"))
    by_line = lines.join(kinds.where("by_line").select("path"), "path", "left_semi").select("path", "pos", F.when(whole, F.trim("value")).alias("item"), F.when(whole, 0).otherwise(F.length("value")).cast("bigint").alias("unread"))
    others = [r.path for r in kinds.where("NOT by_line").select("path").toLocalIterator()]
    return by_line.unionByName(json_items(spark, others)) if others else by_line


def save_interactions(df: DataFrame, path: str, sample: Column | None = None) -> DataFrame:
    """Append interactions to a store, as samples where a column of these is given; the store's index with the new ones.

    A task's rows are committed together, so no lock is needed. The index has
    one row for each id, the first that was saved.
    """
    df.withColumn("body", F.to_json(sample if sample is not None else F.struct(*df.columns))).write.mode("append").json(f"{path}/interactions")
    saved = df.sparkSession.read.json(f"{path}/interactions")
    names = [c for c in ("interaction_id", "persona_id", "num_turns", "created_at", "query_id") if c in saved.columns]
    file = saved.select(*names, F.col("_metadata.file_path").alias("filepath"), F.monotonically_increasing_id().alias("__pos"))
    index = checkpointed(file.groupBy("interaction_id").agg(F.min_by(F.struct(*names, "filepath"), "__pos").alias("r")).select("r.*"))
    index.write.mode("overwrite").json(f"{path}/index")
    return index
