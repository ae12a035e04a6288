"""Usage roll-ups, for batch frames and, where no global order is asked, for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sums():
    return [
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    ]


def totals(usage: DataFrame) -> DataFrame:
    """Calls and tokens overall, by module and by provider/model, in one pass."""
    g = usage.groupingSets([["module"], ["model_key"], []], "module", "model_key").agg(F.grouping("module").alias("gm"), F.grouping("model_key").alias("gk"), *_sums())
    scope = F.when(F.col("gm") == 0, "module").when(F.col("gk") == 0, "model").otherwise("all")
    return g.select(scope.alias("scope"), F.coalesce("module", "model_key", F.lit("")).alias("name"), "calls", "input_tokens", "output_tokens", "total_tokens")


def by_module(usage: DataFrame) -> DataFrame:
    return usage.groupBy("module").agg(*_sums())


def summary(usage: DataFrame) -> DataFrame:
    """Modules in order of name with their line; only one small row a module is ordered."""
    return by_module(usage).withColumn("line", F.row_number().over(Window.orderBy("module")).cast("bigint"))


def running_totals(usage: DataFrame) -> DataFrame:
    """Tokens of each module and day, and those so far."""
    days = usage.groupBy("module", F.to_date("ts").alias("day")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return days.withColumn("so_far", F.sum("tokens").over(Window.partitionBy("module").orderBy("day")))


def windowed(usage: DataFrame, width: str) -> DataFrame:
    """Calls and input tokens of each module and time window."""
    g = usage.groupBy("module", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    return g.select("module", F.col("w.start").alias("bucket"), "calls", "input_tokens")


def source_counts(ids: DataFrame, col: str = "query_id") -> DataFrame:
    """Counts by what stands before the first colon; shares are of all rows, also those without an id."""
    total = ids.agg(F.count("*").alias("n"))
    got = ids.where(F.coalesce(col, F.lit("")) != "").groupBy(F.substring_index(col, ":", 1).alias("source")).agg(F.count("*").alias("count"))
    return got.crossJoin(F.broadcast(total)).select("source", "count", F.round(100.0 * F.col("count") / F.col("n"), 6).alias("pct"))  # one row is sent round


def unused_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").agg(F.count("*").alias("total"), F.count_distinct(F.when(F.col("used"), F.col("doc_id"))).alias("used"), F.count_if(F.col("used").isNull()).alias("unused"))


def least_sampled(strata: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The strata of the least count; unseen ones count 0."""
    n = strata.join(seen, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))
    least = n.agg(F.min("n").alias("least"))
    return n.join(F.broadcast(least), F.col("n") == F.col("least")).select(*keys, "n")  # one row is sent round


def export(usage: DataFrame, path: str, records: bool = True) -> list[str]:
    """The totals, and the single calls unless told not to, as JSON lines in folders below the path."""
    out = [f"{path}/statistics"]
    totals(usage).coalesce(1).write.mode("overwrite").json(out[0])
    if records:
        out.append(f"{path}/records")
        usage.write.mode("overwrite").json(out[1])
    return out
