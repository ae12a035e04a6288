"""Token usage over events: totals, ordering, sources and unused counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dialoom.operators import usage
from dialoom.plans.catalog import query
from dialoom.plans.inputs import table
from dialoom.sources import commitlog, storage
from dialoom.streaming import usage as streams


def _usage(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("module"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"), F.lit("/m"), (F.col("user_id") % 7).cast("string")).alias("model_key"),
        F.floor(F.col("value") * 10).alias("input_tokens"),
        F.floor(F.col("value")).alias("output_tokens"),
        "ts",
    )


USAGE = "u AS (SELECT event_type AS module, 'p' || (user_id % 3) || '/m' || (user_id % 7) AS model_key, floor(value * 10)::BIGINT AS input_tokens, floor(value)::BIGINT AS output_tokens, ts FROM events)"
SUMS = "count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens"


@query("a02_token_totals", f"WITH {USAGE} SELECT CASE WHEN grouping(module) = 0 THEN 'module' WHEN grouping(model_key) = 0 THEN 'model' ELSE 'all' END AS scope, coalesce(module, model_key, '') AS name, {SUMS} FROM u GROUP BY GROUPING SETS ((module), (model_key), ())")
def _(spark, d):
    return usage.totals(_usage(spark, d))


@query("a03_token_summary", f"WITH {USAGE}, m AS (SELECT module, {SUMS} FROM u GROUP BY module) SELECT *, row_number() OVER (ORDER BY module) AS line FROM m")
def _(spark, d):
    return usage.summary(_usage(spark, d))


@query("a02_running_totals", f"WITH {USAGE}, d AS (SELECT module, date_trunc('day', ts)::DATE AS day, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM u GROUP BY ALL) SELECT module, day, tokens, sum(tokens) OVER (PARTITION BY module ORDER BY day)::BIGINT AS so_far FROM d")
def _(spark, d):
    return usage.running_totals(_usage(spark, d))


@query("a04_source_counts", "WITH q AS (SELECT CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS source FROM documents), n AS (SELECT count(*) AS n FROM q) SELECT source, count(*) AS count, round(100.0 * count(*) / (SELECT n FROM n), 6)::DOUBLE AS pct FROM q WHERE source IS NOT NULL GROUP BY source")
def _(spark, d):
    ids = table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("query_id"))
    return usage.source_counts(ids)


@query("a06_unused_summary", "SELECT d.source AS dataset, count(*) AS total, count(DISTINCT l.doc_id) AS used, count(*) FILTER (l.doc_id IS NULL) AS unused FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def _(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.lit(True).alias("used"))
    return usage.unused_summary(table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset")).join(lab, "doc_id", "left"))


@query("a25_least_sampled_strata", "WITH s AS (SELECT l.lang, q.quality, count(x.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (VALUES (0), (1), (2)) q(quality) LEFT JOIN (SELECT d.doc_id, d.lang, b.quality FROM documents d JOIN labels b USING (doc_id)) x ON x.lang = l.lang AND x.quality = q.quality GROUP BY ALL) SELECT lang, quality, n FROM s WHERE n = (SELECT min(n) FROM s)")
def _(spark, d):
    seen = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    langs = table(spark, d, "documents").select("lang").distinct()
    return usage.least_sampled(langs.withColumn("quality", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))), seen, ["lang", "quality"])


@query("a24_validation_tally", "SELECT CASE quality WHEN 1 THEN 'PASS' ELSE CASE toxic WHEN 1 THEN 'FAIL' ELSE 'WARN' END END AS level, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, d):
    level = F.when(F.col("quality") == 1, "PASS").when(F.col("toxic") == 1, "FAIL").otherwise("WARN")
    return table(spark, d, "labels").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("w09_progress_steps", "SELECT event_id FROM events WHERE event_id % 250 = 0")
def _(spark, d):
    return table(spark, d, "events").select("event_id").where(F.col("event_id") % 250 == 0)


@query("d20_metric_points", "SELECT event_id AS step, metric, v AS value FROM (SELECT event_id, unnest(['value', 'k']) AS metric, unnest([value, json_extract_string(props, '$.k')::DOUBLE]) AS v FROM events)")
def _(spark, d):
    wide = table(spark, d, "events").select(F.col("event_id").alias("step"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return wide.unpivot("step", ["value", "k"], "metric", "value")


@query("stream_windowed_totals", f"WITH {USAGE} SELECT module, time_bucket(INTERVAL 6 HOURS, ts) AS bucket, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens FROM u GROUP BY ALL")
def _(spark, d):
    return usage.windowed(_usage(spark, d), "6 hours")


@query("stream_module_totals", f"WITH {USAGE} SELECT module, {SUMS} FROM u GROUP BY module")
def _(spark, d):
    """The same totals by a stream over the table's files, run to its end into a memory sink."""
    path = f"{d}/events.parquet"
    raw = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    rows = raw.select(F.col("event_type").alias("module"), F.floor(F.col("value") * 10).alias("input_tokens"), F.floor("value").alias("output_tokens"), "ts")
    name = f"totals_{uuid.uuid4().hex}"
    q = streams.running_module_totals(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{storage.checkpoint_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("k10_commit_log", "SELECT event_id, user_id, value, event_id % 3 AS part FROM events")
def _(spark, d):
    """Events appended to a log in three commits, and read back."""
    path = f"{storage.checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        commitlog.append(events.where(F.col("part") == part), path)
    return commitlog.read(spark, path, "event_id bigint, user_id bigint, value double, part bigint").drop("commit", "file", "pos")


@query("k11_streamed_log", f"WITH {USAGE} SELECT module, {SUMS} FROM u GROUP BY module")
def _(spark, d):
    """Calls logged by a stream, each micro-batch a commit, and added up from the log."""
    at = f"{storage.checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    raw = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    rows = raw.select(F.col("event_type").alias("module"), F.floor(F.col("value") * 10).alias("input_tokens"), F.floor("value").alias("output_tokens"))
    commitlog.append_stream(rows, f"{at}/log", f"{at}/checkpoint", "calls").awaitTermination()
    return usage.by_module(commitlog.read(spark, f"{at}/log", "module string, input_tokens bigint, output_tokens bigint"))
