"""Group-relative advantages, failure windows and evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_advantage(rollouts: DataFrame, state: str, reward: str = "reward", eps: float = 1e-8) -> DataFrame:
    """(reward - mean) / (population deviation + eps) among the valid rollouts of a state; 0 for a lone one.

    Sums are combined on the map side and joined back, so that a state of very
    many rollouts is no hot group.
    """
    ok = rollouts.where(F.col(reward).isNotNull())
    g = ok.groupBy(state).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"), F.count("*").alias("__n"))
    return ok.join(g, state).withColumn("advantage", F.when(F.col("__n") <= 1, 0.0).otherwise((F.col(reward) - F.col("__m")) / (F.col("__s") + eps))).drop("__m", "__s", "__n")


def sliding_failure(steps: DataFrame, width: int, limit: float, run: str | None = None) -> DataFrame:
    """Mean failure rate of the last steps; abort once a full window is over the limit.

    One row a step is ordered, within its run where there is a column of runs.
    """
    keys = [run] if run else []
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(1 - width, 0)
    return steps.select(*keys, "step", F.avg("rate").over(w).alias("mean_rate"), F.count("*").over(w).alias("n")).select(*keys, "step", "mean_rate", ((F.col("n") == width) & (F.col("mean_rate") > limit)).alias("abort"))


def watched_runs(steps: DataFrame, width: int = 5, limit: float = 0.8) -> DataFrame:
    """(run, step, event, mean_rate, tokens): each step's mean rate of the last steps and tokens so far, and the first abort of a run.

    The batch form of streaming.state.watched_runs, over (run, step, rate, tokens).
    """
    order = Window.partitionBy("run").orderBy("step")
    last = order.rowsBetween(1 - width, 0)
    rows = steps.select("run", "step", F.avg("rate").over(last).alias("mean_rate"), F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("tokens"), F.count("*").over(last).alias("n"))
    over = (F.col("n") == width) & (F.col("mean_rate") > limit)
    first = F.min(F.when(over, F.col("step"))).over(Window.partitionBy("run"))
    events = F.when(F.col("step") == first, F.array(F.lit("step"), F.lit("abort"))).otherwise(F.array(F.lit("step")))
    return rows.withColumn("events", events).select("run", "step", F.explode("events").alias("event"), "mean_rate", "tokens")


def batch_scores(results: DataFrame, size: int) -> DataFrame:
    """Means of each run of lines; malformed lines keep their place, and all means divide by the rows with original scores."""
    scored = F.col("parsed") & F.col("original_scores.persona_score").isNotNull()
    n = F.count_if(scored)
    mean = lambda c: F.sum(F.when(F.col("parsed"), F.col(c))).cast("double") / n
    g = results.groupBy(F.floor(F.col("pos") / size).alias("batch")).agg(
        n.alias("n"),
        mean("original_scores.persona_score").alias("op"),
        mean("original_scores.task_score").alias("ot"),
        mean("optimized_scores.persona_score").alias("np"),
        mean("optimized_scores.task_score").alias("nt"),
    )
    g = g.where("n > 0").withColumns({"original_total": (F.col("op") + F.col("ot")) / 2, "optimized_total": (F.col("np") + F.col("nt")) / 2})
    return g.withColumn("delta", F.col("optimized_total") - F.col("original_total"))


def overall_scores(batches: DataFrame) -> DataFrame:
    """Batch means weighted by their rows."""
    n = F.sum("n")
    return batches.agg(n.alias("n"), *[(F.sum(F.col(c) * F.col("n")) / n).alias(c) for c in ("original_total", "optimized_total")])


def with_deltas(results: DataFrame) -> DataFrame:
    d = lambda f: F.col(f"optimized_scores.{f}") - F.col(f"original_scores.{f}")
    return results.withColumns({"persona_delta": d("persona_score"), "task_delta": d("task_score"), "total_delta": (d("persona_score") + d("task_score")) / 2.0})


def checkpoint_summary(results: DataFrame, key: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return with_deltas(results).groupBy(key).agg(
        F.count("*").alias("n"),
        zero(F.avg("optimized_scores.persona_score")).alias("persona"),
        zero(F.avg("optimized_scores.task_score")).alias("task"),
        zero(F.avg("persona_delta")).alias("persona_delta"),
        zero(F.avg("task_delta")).alias("task_delta"),
    )


def fan_out(items: DataFrame, checkpoints: list[int], failed: list[int]) -> DataFrame:
    """Each item for each checkpoint that did not fail: an explode of a literal, no join."""
    return items.withColumn("checkpoint", F.explode(F.array(*[F.lit(c).cast("bigint") for c in checkpoints if c not in failed])))


def joined_results(baseline: DataFrame, inference: DataFrame, scored: DataFrame) -> DataFrame:
    """Inference with its scores and the baseline that all checkpoints share; missing parts drop the row."""
    return inference.join(scored, ["item_id", "checkpoint"]).join(baseline, "item_id")
