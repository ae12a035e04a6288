"""Rewards, advantages, losses, schedules and evaluation over events and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dialoom.functions import arith
from dialoom.operators import evaluation, samples
from dialoom.plans.catalog import query
from dialoom.plans.inputs import table
from dialoom.sources import storage
from dialoom.streaming import state
from dialoom.streaming import usage as streams


def _events(spark, d):
    return table(spark, d, "events")


@query(
    "m01_combined_reward",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id % 5) / 4.0::DOUBLE END AS p, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 2)::DOUBLE END AS t FROM events)
    SELECT event_id, round(coalesce(0.3::DOUBLE * p + 0.7::DOUBLE * t, 0), 6) AS total, (p + t) IS NULL AS failed FROM r""",
)
def _(spark, d):
    p = F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 5) / 4.0)
    t = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 2).cast("double"))
    return _events(spark, d).select("event_id", arith.combined_reward(p, t).alias("r")).select("event_id", F.round("r.total", 6).alias("total"), "r.failed")


@query("m01_task_only_reward", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 2 END::DOUBLE AS total, event_id % 13 = 0 AS failed FROM events")
def _(spark, d):
    t = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 2).cast("double"))
    return _events(spark, d).select("event_id", arith.combined_reward(F.lit(None).cast("double"), t, w_task=1.0, task_only=True).alias("r")).select("event_id", "r.total", "r.failed")


@query(
    "w01_group_advantage",
    """WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS r FROM events), g AS (SELECT user_id, avg(r) AS m, stddev_pop(r) AS s, count(r) AS n FROM v GROUP BY user_id)
    SELECT event_id, round(CASE WHEN n <= 1 THEN 0 ELSE (r - m) / (s + 1e-8::DOUBLE) END, 6)::DOUBLE AS advantage FROM v JOIN g USING (user_id) WHERE r IS NOT NULL""",
)
def _(spark, d):
    r = _events(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 8 != 0, F.col("value")).alias("reward"))
    return evaluation.group_advantage(r, "user_id").select("event_id", F.round("advantage", 6).alias("advantage"))


@query(
    "w02_sliding_failure_rate",
    """WITH s AS (SELECT event_id // 50 AS step, avg((value > 20)::INT) AS rate FROM events GROUP BY ALL), w AS (SELECT step, avg(rate) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean, count(*) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM s)
    SELECT step, round(mean, 6) AS mean_rate, coalesce(n = 5 AND mean > 0.5, false) AS abort FROM w""",
)
def _(spark, d):
    steps = _events(spark, d).groupBy(F.floor(F.col("event_id") / 50).alias("step")).agg(F.avg((F.col("value") > 20).cast("int")).alias("rate"))
    return evaluation.sliding_failure(steps, 5, 0.5).select("step", F.round("mean_rate", 6).alias("mean_rate"), "abort")


_WATCHED = """
WITH w AS (SELECT user_id AS run, event_id AS step, avg((value > 20)::INT) OVER l AS mean_rate, count(*) OVER l AS n,
  sum(floor(value * 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS tokens
  FROM events WINDOW l AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT run, step, 'step' AS event, round(mean_rate, 6) AS mean_rate, tokens FROM w
UNION ALL SELECT run, min(step), 'abort', round(arg_min(mean_rate, step), 6), arg_min(tokens, step) FROM w WHERE n = 5 AND mean_rate > 0.5 GROUP BY run"""


def _steps(events):
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("value") > 20).cast("int").alias("rate"), F.floor(F.col("value") * 10).alias("tokens"), F.col("ts").alias("at"))


@query("w02_watched_runs", _WATCHED)
def _(spark, d):
    return evaluation.watched_runs(_steps(_events(spark, d)), 5, 0.5).withColumn("mean_rate", F.round("mean_rate", 6))


@query("w02_watched_runs_stream", _WATCHED)
def _(spark, d):
    """The same by state that a stream keeps, over the table's files, into a folder."""
    path = f"{d}/events.parquet"
    folder = f"{storage.checkpoint_dir(spark)}/watched-{uuid.uuid4().hex}"
    raw = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    rows = state.watched_runs(_steps(raw), 5, 0.5, idle="3650 days")
    rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(state.WATCHED).parquet(f"{folder}/rows").withColumn("mean_rate", F.round("mean_rate", 6))


@query("a21_step_means", "SELECT event_id // 50 AS step, round(coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 0), 6) AS mean_reward, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS fail_rate FROM events GROUP BY ALL")
def _(spark, d):
    r = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return _events(spark, d).groupBy(F.floor(F.col("event_id") / 50).alias("step")).agg(F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias("mean_reward"), F.round(F.count_if(r.isNull()) / F.count("*"), 6).alias("fail_rate"))


TOKENS = """t AS (SELECT event_id, unnest(range(6)) AS i FROM events), x AS (SELECT event_id, i, -0.1::DOUBLE * ((event_id + i) % 7) AS n, -0.1::DOUBLE * ((event_id + 2 * i) % 5) AS o, CASE WHEN i < 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS w, ((event_id % 5) - 2)::DOUBLE AS a FROM t)"""


def _tokens(spark, d):
    i = F.sequence(F.lit(0), F.lit(5))
    return _events(spark, d).select(
        "event_id",
        F.transform(i, lambda k: F.lit(-0.1) * ((F.col("event_id") + k) % 7)).alias("n"),
        F.transform(i, lambda k: F.lit(-0.1) * ((F.col("event_id") + 2 * k) % 5)).alias("o"),
        F.transform(i, lambda k: F.when(k < 2, 0.0).otherwise(1.0)).alias("w"),
        ((F.col("event_id") % 5) - 2).cast("double").alias("a"),
    )


@query("m02_clipped_loss", f"WITH {TOKENS} SELECT event_id, round(sum(w * -least(exp(n - o) * a, greatest(0.8::DOUBLE, least(1.2::DOUBLE, exp(n - o))) * a)) / greatest(sum(w), 1), 6) AS loss FROM x GROUP BY event_id")
def _(spark, d):
    return _tokens(spark, d).select("event_id", F.round(arith.masked_mean(arith.clipped_loss(F.col("n"), F.col("o"), F.col("a")), F.col("w")), 6).alias("loss"))


@query("m03_kl", f"WITH {TOKENS} SELECT event_id, round(sum(w * (exp(o - n) + (n - o) - 1)) / greatest(sum(w), 1), 6) AS kl FROM x GROUP BY event_id")
def _(spark, d):
    return _tokens(spark, d).select("event_id", F.round(arith.masked_mean(arith.kl_terms(F.col("n"), F.col("o")), F.col("w")), 6).alias("kl"))


@query("a22_mean_loss", f"WITH {TOKENS}, s AS (SELECT event_id, sum(w * -n) / greatest(sum(w), 1) AS l FROM x GROUP BY event_id) SELECT round(sum(l::DECIMAL(28,12))::DOUBLE / count(*), 6) AS mean_loss FROM s")
def _(spark, d):
    # an exact sum: the mean lies on a rounding boundary, where the order of adding would show
    loss = arith.masked_mean(F.transform("n", lambda v: -v), F.col("w")).cast("decimal(28,12)")
    return _tokens(spark, d).agg(F.round(F.sum(loss).cast("double") / F.count("*"), 6).alias("mean_loss"))


@query("a23_sft_token_loss", f"WITH {TOKENS}, b AS (SELECT event_id // 32 AS batch, sum(w) AS tokens, sum(w * -n) AS loss FROM x GROUP BY ALL) SELECT batch, tokens, round(CASE WHEN tokens > 0 THEN loss / tokens ELSE loss END, 6) AS mean_loss FROM b")
def _(spark, d):
    zero = F.lit(0.0)
    t = _tokens(spark, d).select(F.floor(F.col("event_id") / 32).alias("batch"), F.aggregate("w", zero, lambda a, x: a + x).alias("t"), F.aggregate(F.zip_with("n", "w", lambda n, w: -n * w), zero, lambda a, x: a + x).alias("l"))
    g = t.groupBy("batch").agg(F.sum("t").alias("tokens"), F.sum("l").alias("l"))
    return g.select("batch", "tokens", F.round(F.when(F.col("tokens") > 0, F.col("l") / F.col("tokens")).otherwise(F.col("l")), 6).alias("mean_loss"))


@query("m04_aligned_datum", "SELECT event_id, 2 + event_id % 3 - 1 + 4 AS n, 4.0::DOUBLE AS weight_sum, 4 * (event_id % 5)::DOUBLE AS advantage_sum FROM events")
def _(spark, d):
    x = _events(spark, d).select("event_id", arith.aligned((2 + F.col("event_id") % 3).cast("int"), F.array_repeat(F.lit(1), 4), (F.col("event_id") % 5).cast("double")).alias("x"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return x.select("event_id", F.size("x.weights").cast("bigint").alias("n"), total(F.col("x.weights")).alias("weight_sum"), total(F.col("x.advantages")).alias("advantage_sum"))


@query("m05_learning_rate", "WITH s AS (SELECT DISTINCT event_id // 50 AS s FROM events), n AS (SELECT count(*) AS n, greatest(1, count(*) // 10) AS w FROM s) SELECT s AS step, round(CASE WHEN s < w THEN 0.0001::DOUBLE * s / w ELSE 0.00001::DOUBLE + 0.5::DOUBLE * 0.00009::DOUBLE * (1 + cos(pi() * (s - w) / (n - w)::DOUBLE)) END, 12) AS lr FROM s, n")
def _(spark, d):
    """A rate for each step of fifty events, a tenth of them to warm up."""
    steps = _events(spark, d).select(F.floor(F.col("event_id") / 50).alias("step")).distinct()
    n = steps.count()
    return steps.select("step", F.round(arith.learning_rate(F.col("step"), n, 1e-4, 1e-5, max(1, n // 10)), 12).alias("lr"))


@query("m06_left_truncation", "WITH x AS (SELECT event_id, event_id % 9 AS p, event_id % 6 AS c FROM events) SELECT event_id, CASE WHEN c >= 4 THEN 0 ELSE least(p, 4 - c) END AS kept_prompt, least(c, 4) AS kept_completion, CASE WHEN c < 4 AND least(p, 4 - c) > 0 THEN p - least(p, 4 - c) + 1 END AS first_prompt FROM x")
def _(spark, d):
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    x = _events(spark, d).select("event_id", arith.left_truncated(seq(F.col("event_id") % 9), seq(F.col("event_id") % 6), 4).alias("x"))
    return x.select("event_id", F.size("x.prompt").cast("bigint").alias("kept_prompt"), F.size("x.completion").cast("bigint").alias("kept_completion"), F.get("x.prompt", F.lit(0)).cast("bigint").alias("first_prompt"))


@query("m07_steps", "SELECT event_id, (ceil((event_id + 1) / 8.0) * 3)::BIGINT AS steps FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", arith.steps(F.col("event_id") + 1, 8, 3).alias("steps"))


@query("m13_missing_logprobs", "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 0 ELSE -value END - 1, 6) AS s FROM events")
def _(spark, d):
    x = F.array(F.when(F.col("event_id") % 2 != 0, -F.col("value")), F.lit(-1.0))
    return _events(spark, d).select("event_id", F.round(F.aggregate(arith.filled(x), F.lit(0.0), lambda a, v: a + v), 6).alias("s"))


def _results(spark, d):
    e = _events(spark, d)
    ok = F.col("event_id") % 11 != 0
    s = lambda k: F.when(ok, (F.col("event_id") * k % 10 + 1).cast("int"))
    return e.select(F.col("event_id").alias("pos"), (F.col("event_id") % 17 != 0).alias("parsed"), F.struct(s(3).alias("persona_score"), s(7).alias("task_score")).alias("original_scores"), F.struct(s(5).alias("persona_score"), s(9).alias("task_score")).alias("optimized_scores"), (F.col("user_id") % 4).alias("checkpoint"))


RESULTS = "r AS (SELECT event_id AS pos, event_id % 11 <> 0 AND event_id % 17 <> 0 AS ok, (event_id * 3 % 10 + 1)::DOUBLE AS op, (event_id * 7 % 10 + 1)::DOUBLE AS ot, (event_id * 5 % 10 + 1)::DOUBLE AS np, (event_id * 9 % 10 + 1)::DOUBLE AS nt, user_id % 4 AS checkpoint FROM events)"
BATCHES = "b AS (SELECT pos // 25 AS batch, count(*) FILTER (ok) AS n, sum(op) FILTER (ok) / count(*) FILTER (ok) AS op, sum(ot) FILTER (ok) / count(*) FILTER (ok) AS ot, sum(np) FILTER (pos % 17 <> 0 AND pos % 11 <> 0) / count(*) FILTER (ok) AS np, sum(nt) FILTER (pos % 17 <> 0 AND pos % 11 <> 0) / count(*) FILTER (ok) AS nt FROM r GROUP BY ALL HAVING count(*) FILTER (ok) > 0)"


@query("a12_batch_scores", f"WITH {RESULTS}, {BATCHES} SELECT batch, n, round((op + ot) / 2, 6) AS original_total, round((np + nt) / 2, 6) AS optimized_total, round((np + nt) / 2 - (op + ot) / 2, 6) AS delta FROM b")
def _(spark, d):
    b = evaluation.batch_scores(_results(spark, d), 25)
    return b.select("batch", "n", *[F.round(c, 6).alias(c) for c in ("original_total", "optimized_total", "delta")])


@query("a13_overall_scores", f"WITH {RESULTS}, {BATCHES} SELECT sum(n)::BIGINT AS n, round(sum((op + ot) / 2 * n) / sum(n), 6) AS original_total, round(sum((np + nt) / 2 * n) / sum(n), 6) AS optimized_total FROM b")
def _(spark, d):
    o = evaluation.overall_scores(evaluation.batch_scores(_results(spark, d), 25))
    return o.select("n", *[F.round(c, 6).alias(c) for c in ("original_total", "optimized_total")])


@query("m09_score_deltas", "SELECT event_id AS pos, (event_id * 5 % 10) - (event_id * 3 % 10) AS persona_delta, (event_id * 9 % 10) - (event_id * 7 % 10) AS task_delta, (((event_id * 5 % 10) - (event_id * 3 % 10)) + ((event_id * 9 % 10) - (event_id * 7 % 10))) / 2.0::DOUBLE AS total_delta FROM events WHERE event_id % 11 <> 0")
def _(spark, d):
    x = evaluation.with_deltas(_results(spark, d).where(F.col("pos") % 11 != 0))
    return x.select("pos", F.col("persona_delta").cast("bigint").alias("persona_delta"), F.col("task_delta").cast("bigint").alias("task_delta"), "total_delta")


@query("a14_checkpoint_summary", f"WITH {RESULTS} SELECT checkpoint, count(*) AS n, round(avg(np), 6) AS persona, round(avg(nt), 6) AS task, round(avg(np - op), 6) AS persona_delta FROM r WHERE pos % 11 <> 0 GROUP BY checkpoint")
def _(spark, d):
    g = evaluation.checkpoint_summary(_results(spark, d).where(F.col("pos") % 11 != 0), "checkpoint")
    return g.select("checkpoint", "n", *[F.round(c, 6).alias(c) for c in ("persona", "task", "persona_delta")])


@query("j08_items_by_checkpoints", "SELECT item_id, c AS checkpoint FROM benchmark, range(3) t(c) WHERE c <> 1")
def _(spark, d):
    items = table(spark, d, "benchmark").select("item_id")
    return evaluation.fan_out(items, [0, 1, 2], failed=[1])


@query(
    "j07_three_way_results",
    "SELECT b.item_id, c AS checkpoint, length(b.text) AS baseline, length(b.text) + c AS optimized FROM benchmark b, range(3) t(c) WHERE b.item_id % 5 <> 0 AND (b.item_id + c) % 4 <> 0",
)
def _(spark, d):
    items = table(spark, d, "benchmark")
    base = items.where(F.col("item_id") % 5 != 0).select("item_id", F.length("text").cast("bigint").alias("baseline"))
    fan = evaluation.fan_out(items, [0, 1, 2], failed=[])
    scored = fan.where((F.col("item_id") + F.col("checkpoint")) % 4 != 0).select("item_id", "checkpoint", (F.length("text") + F.col("checkpoint")).alias("optimized"))
    return evaluation.joined_results(base, fan.select("item_id", "checkpoint"), scored).select("item_id", "checkpoint", "baseline", "optimized")


@query("o02_item_order", "SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark")
def _(spark, d):
    return samples.ranked(table(spark, d, "benchmark").select("item_id"), [F.col("item_id")], "place")


@query("c08_rollout_evaluation", "SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (value > b)::INT::DOUBLE END AS r_task, event_id % 6 = 0 AS failed FROM events JOIN (SELECT user_id, avg(value) AS b FROM events GROUP BY user_id) USING (user_id)")
def _(spark, d):
    e = _events(spark, d)
    base = e.groupBy("user_id").agg(F.avg("value").alias("b"))  # once a state, then joined
    r = F.when(F.col("event_id") % 6 != 0, (F.col("value") > F.col("b")).cast("int").cast("double"))
    return e.join(base, "user_id").select("event_id", "user_id", r.alias("r_task"), r.isNull().alias("failed"))
