"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import checkpointed

#: A vertex of very many links is dealt into so many parts when its minimum is joined back.
SALTS = 8
#: Links, after each partition has contracted its own, that one task contracts further; with so few no round is needed.
LINKS = 1 << 17


def _contracted(links: DataFrame) -> DataFrame:
    """Each partition's own links as stars; no shuffle, memory in proportion to the partition."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(u), root(v)
                parent[max(x, y)] = min(x, y)
        got = [(x, root(x)) for x in list(parent)]
        got = [(x, r) for x, r in got if x != r]
        for at in range(0, len(got), 10_000):
            part = got[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])

    return links.mapInArrow(run, "u bigint, v bigint")


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the least of u and its neighbours; hubs are salted."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    spread = least.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(spread.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    j = _with_least(links)
    return j.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("x")).select("x.*")
    roles = ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return roles.where("child > 1 OR (child > 0 AND parent > 0)").isEmpty()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): for each vertex of a link that is not the least of its component, the least one.

    A bounded driver loop (rounds grow with the logarithm of the longest
    path); each round is cut off by a checkpoint, and only whether it is over
    comes to the driver. Where LINKS links or fewer are left of all partitions,
    one task's stars are the components.
    """
    now = checkpointed(_contracted(links.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v"))))
    tasks = -(-now.count() // LINKS)
    now = _contracted(now.coalesce(max(1, tasks)))
    if tasks <= 1:
        return checkpointed(now).select(F.col("u").alias("id"), F.col("v").alias("component"))
    now = checkpointed(now.distinct())
    while not _are_stars(now):
        now = checkpointed(_small_star(checkpointed(_large_star(now))))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
