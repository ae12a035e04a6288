"""Conversations to training samples, exports, statistics, splits and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.text import first_truthy
from dialoom.operators.selection import parted


def interactions(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation with its messages in turn order; one shuffle on the key."""
    msg = F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(msg)).alias("messages"))


#: What stands between the texts of a history.
TURN_MARK = "\x1f"


def histories(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, history): a conversation's texts joined once, in turn order."""
    m = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(m, lambda x: x["text"]), TURN_MARK).alias("history"))


def history_ends(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, upto): the history before a turn is the first `upto` characters of its conversation's.

    A running sum of lengths; so what is kept is in proportion to a
    conversation, whatever its number of turns, and prefixes are taken when read.
    """
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit(""))) + len(TURN_MARK)
    return messages.select(key, "turn", size.alias("__n")).select(key, "turn", F.greatest(F.coalesce(F.sum("__n").over(before), F.lit(0)) - len(TURN_MARK), F.lit(0)).alias("upto"))


def user_prompts(messages: Column) -> Column:
    """What the user said, in order."""
    return F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit("")))


def role_content(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def followups(messages: Column) -> Column:
    """User messages after the first one."""
    return F.slice(user_prompts(messages), 2, 1_000_000)


def training_samples(inter: DataFrame, key: str = "conv_id", include_trajectory: bool = True, include_full: bool = True) -> DataFrame:
    """One sample per conversation; parts left out by a flag are cut to the first prompt or emptied."""
    prompts = user_prompts(F.col("messages"))
    none = F.slice(role_content(F.col("messages")), 1, 0)
    return inter.select(
        F.col(key).alias("sample_id"),
        F.get(prompts, F.lit(0)).alias("initial_query"),
        (prompts if include_trajectory else F.slice(prompts, 1, 1)).alias("prompt_trajectory"),
        (role_content(F.col("messages")) if include_full else none).alias("full_conversation"),
        F.size(prompts).cast("bigint").alias("num_turns"),
    )


def utterances(conversation: Column) -> Column:
    """struct(user, assistant): contents by role, the role stripped and lower-cased."""
    by = lambda r: F.transform(F.filter(conversation, lambda m: F.lower(F.trim(m["role"])) == r), lambda m: m["content"])
    return F.struct(by("user").alias("user"), by("assistant").alias("assistant"))


def statistics(samples: DataFrame, persona: str = "persona_id") -> DataFrame:
    """Counts over all samples; zeros, not nulls, for none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return samples.agg(
        F.count("*").alias("total_samples"),
        zero(F.avg("num_turns")).cast("double").alias("avg_turns"),
        zero(F.min("num_turns")).alias("min_turns"),
        zero(F.max("num_turns")).alias("max_turns"),
        F.count_distinct(persona).alias("unique_personas"),
        zero(F.sum(F.size("prompt_trajectory"))).cast("bigint").alias("total_prompts"),
    )


def ranked(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """A global row number without a single-partition window.

    Rows are range-partitioned and sorted; each partition's size is counted,
    and the offsets, one number a partition, come back as a small table.
    """
    from dialoom.sources.storage import checkpointed

    keys = [f"__o{i}" for i in range(len(order))]
    laid = checkpointed(df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys))
    laid = laid.withColumn("__p", F.spark_partition_id())
    sizes = {r["__p"]: r["n"] for r in laid.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    # monotonically_increasing_id counts rows within a partition in its lower 33 bits
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__p int, __at bigint")
    return laid.withColumn("__i", local).join(F.broadcast(table), "__p").withColumn(name, F.col("__at") + F.col("__i") + 1).drop("__p", "__i", "__at", *keys)


def export_statistics(samples: DataFrame, path: str, persona: str = "persona_id", stamp: bool = True) -> str:
    """The counts over all samples as one JSON file in a folder of its own, named by the time unless told not to; its path."""
    from datetime import datetime

    now = datetime.now()
    at = f"{path}/statistics" + (now.strftime("_%Y%m%d_%H%M%S") if stamp else "")
    statistics(samples, persona).withColumn("generated_at", F.lit(now.isoformat())).coalesce(1).write.mode("overwrite").json(at)
    return at


def split(df: DataFrame, key: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """train, val or test for each row: exact sizes, cut off a shuffled order by truncation; no row is shuffled."""
    n = df.count()
    part = parted(df, key, seed, [int(n * train), int(n * val)], "__part")
    return part.withColumn("split", F.when(F.col("__part") == 0, "train").when(F.col("__part") == 1, "val").otherwise("test")).drop("__part")


def keep_first(df: DataFrame, keys: list[Column | str], pos: str, bypass: Column | None = None) -> DataFrame:
    """The row of least pos for each key; rows where bypass holds are all kept.

    min_by combines on the map side, so a key of very many rows is no hot group.
    """
    cols = df.columns
    kept = df if bypass is None else df.where(~bypass)
    named = {f"__k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    first = kept.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*cols), F.col(pos)).alias("__r")).select("__r.*")
    return first if bypass is None else first.unionByName(df.where(bypass).select(*cols))


def keep_last(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row of greatest pos for each key, with the key's first position as first_pos."""
    cols = df.columns
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*cols), F.col(pos)).alias("__r"), F.min(pos).alias("first_pos")).select("__r.*", "first_pos")


def dataset_query_id(source: Column, text: Column, index: Column, *ids: Column) -> Column:
    """source:id of the first id that is not empty, else a hash of source, load index and text."""
    found = first_truthy(*ids)
    return F.coalesce(F.concat(source, F.lit(":"), found), F.concat(F.lit("hash:"), F.substring(F.sha1(F.concat(source, F.lit(":"), index.cast("string"), F.lit(":"), text)), 1, 16)))


def stored_query_id(source: Column, text: Column, *ids: Column) -> Column:
    """As stored: a bare id without a source, and a hash without the index."""
    found = first_truthy(*ids)
    src = F.nullif(source, F.lit(""))
    named = F.when(src.isNull(), found).otherwise(F.concat(src, F.lit(":"), found))
    return F.coalesce(named, F.concat(F.lit("hash:"), F.substring(F.sha1(F.concat(F.coalesce(src, F.lit("unknown")), F.lit(":"), text)), 1, 16)))


def disjoint_subsets(df: DataFrame, key: str, seed: str, n_first: int, n_second: int) -> DataFrame:
    """part 1 and part 2 of so many rows each, without a common key; an error if there are too few."""
    once = df.groupBy(key).agg(F.count("*").alias("copies"))
    n = once.count()
    if n < n_first + n_second:
        raise ValueError(f"{n_first + n_second} distinct rows wanted, {n} there")
    return parted(once, key, seed, [n_first, n_second], "__part").where("__part < 2").withColumn("part", (F.col("__part") + 1).cast("int")).drop("__part")
