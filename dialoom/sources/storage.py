"""Readers and writers: JSON in its several shapes, keyed tables, splits and logs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import nested
from dialoom.functions.text import first_truthy


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Where that is unset, a local session gets a default and a cluster an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# ---- sources


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones too unless strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_documents(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON: an object or an array of objects for each file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_values(body: Column) -> Column:
    """The comma-separated JSON values of a text as array<variant>; null if it is anything else.

    Spark's parser stops behind the first value; the mark behind the values
    tells whether it came to the end.
    """
    read = F.try_variant_get(F.try_parse_json(F.concat(F.lit("[["), body, F.lit('],"end"]'))), "$", "array<variant>")
    return F.when(F.try_variant_get(F.get(read, F.lit(1)), "$", "string") == "end", F.try_variant_get(F.get(read, F.lit(0)), "$", "array<variant>"))


def is_json(line: Column) -> Column:
    """Whether a text is one JSON value and no more."""
    return F.coalesce(F.size(json_values(line)) == 1, F.lit(False))


def query_text(item: Column) -> Column:
    """The text of a query item given as JSON: a string itself, the first usable field, or the first turn."""
    obj = lambda f: F.get_json_object(item, f"$.{f}")
    plain = F.when(item.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), item, F.lit("}")), "$.v"))
    return first_truthy(plain, *[obj(f) for f in ("instruction", "query", "question", "prompt", "text", "input")], F.get_json_object(item, "$.conversations[0].value"))


def read_queries(spark: SparkSession, paths: list[str], max_queries: int | None = None) -> DataFrame:
    """(source, file_ord, pos, item, text) of JSONL and JSON files in the listed order; missing files are skipped."""
    out = None
    for ord_, path in enumerate(paths):
        if "://" not in path and not os.path.exists(path):
            continue
        if path.endswith(".jsonl"):
            rows = spark.read.text(path).where(F.trim("value") != "").where(is_json(F.col("value"))).select(F.col("value").alias("item"), F.monotonically_increasing_id().alias("pos"))
        else:
            whole = spark.read.text(path, wholetext=True).select(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.queries")).alias("v"))
            rows = whole.select(F.posexplode(F.from_json("v", "array<variant>"))).select(F.to_json("col").alias("item"), F.col("pos").cast("bigint"))
        rows = rows.select(F.lit(os.path.splitext(os.path.basename(path))[0]).alias("source"), F.lit(ord_).alias("file_ord"), "pos", "item", query_text(F.col("item")).alias("text")).where("text IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "source string, file_ord int, pos bigint, item string, text string")
    return out if max_queries is None else out.orderBy("file_ord", "pos").limit(max_queries)


def read_any_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, pos, item): what scans.read_any_json can read, without its notes of what it cannot."""
    from dialoom.sources import scans

    return scans.read_any_json(spark, path).where("item IS NOT NULL").drop("unread")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of a key; FileNotFoundError if there are none."""
    got = df.where(F.col(key) == value)
    if got.isEmpty():
        raise FileNotFoundError(f"{key} {value!r}")
    return got


def with_query_id(df: DataFrame, item: str) -> DataFrame:
    """A query_id column: metadata.query_id if usable, else the item's first query_id; malformed JSON has none.

    Read by expression where metadata has it, elsewhere by a search that takes
    any depth.
    """
    fast = F.nullif(F.get_json_object(item, "$.metadata.query_id"), F.lit(""))
    easy = df.where(fast.isNotNull()).withColumn("query_id", fast)
    return easy.unionByName(nested.first_value(df.where(fast.isNull()), item, "query_id", "query_id"))


# ---- sinks


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of the same key."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*existing.columns), "__new").alias("r")).select("r.*")


def index_of(df: DataFrame, key: str) -> DataFrame:
    """The derived catalogue: keys and how many rows each has."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def append_first_wins(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows first, then new ones with new keys."""
    both = existing.withColumn("__prio", F.lit(0)).unionByName(new.withColumn("__prio", F.lit(1)))
    return both.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*existing.columns), "__prio").alias("r")).select("r.*")


def export_dataset(df: DataFrame, path: str, features: bool = True, prompts: bool = True, prompt: str = "system_prompt", drop_empty: bool = True) -> None:
    """The personas that have a prompt, as JSON lines or a YAML list by the path's ending; drop_empty also leaves out empty ones.

    In YAML each is an entry in flow style, so the parts of the folder, one
    after the other, are one list.
    """
    if not path.endswith((".json", ".jsonl", ".yaml", ".yml")):
        raise ValueError(f"unknown format: {path}")
    kept = df.where((F.coalesce(prompt, F.lit("")) != "") if drop_empty else F.col(prompt).isNotNull()) if prompts else df
    gone = ([] if features else ["features"]) + ([] if prompts else [prompt])
    kept = kept.drop(*gone)
    if path.endswith((".yaml", ".yml")):
        kept.select(F.concat(F.lit("- "), F.to_json(F.struct(*kept.columns)))).write.mode("overwrite").text(path)
    else:
        kept.write.mode("overwrite").json(path)


def export_splits(df: DataFrame, path: str, split: str | None = "split") -> list[str]:
    """A folder for each of train, val and test, or one train_samples folder."""
    if split is None:
        df.write.mode("overwrite").json(f"{path}/train_samples")
        return [f"{path}/train_samples"]
    out = []
    for name in ("train", "val", "test"):
        df.where(F.col(split) == name).drop(split).write.mode("overwrite").json(f"{path}/{name}_samples")
        out.append(f"{path}/{name}_samples")
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def project_log(states: Column, state_fields: list[str] | None, rollout_fields: list[str] | None, rollouts: str = "rollouts") -> Column:
    """Nested states with only the named fields on two levels; None keeps all."""
    if state_fields is None and rollout_fields is None:
        return states

    def one(s):
        cols = [s[f].alias(f) for f in state_fields or []]
        inner = s[rollouts] if rollout_fields is None else F.transform(s[rollouts], lambda r: F.struct(*[r[f].alias(f) for f in rollout_fields]))
        return F.struct(*cols, inner.alias(rollouts))

    return F.transform(states, one)


def escape_latex(c: Column) -> Column:
    """Special characters of LaTeX as commands, each once."""
    # LaTeX escapes.
    escapes = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}
    known = F.create_map(*[F.lit(x) for kv in escapes.items() for x in kv])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(known, x), x)), "")
