"""Operators around a language-model client, with the mock one, and the shapes that go in and come out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dialoom.functions import arith, text
from dialoom.operators import dialogue, evaluation, ledger, personas, usage
from dialoom.plans.catalog import query
from dialoom.plans.inputs import interactions, table
from dialoom.sources import storage


def _asked(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.replace("text", F.lit("\n"), F.lit(" ")).alias("query"))


@query(
    "t03_noise_prompt",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '- home_language: ' || lang ELSE '(no persona)' END || chr(10) || '(no slots)' || chr(10) || '1. **typo**: typo' || chr(10) || '2. **' || source || '**: ' || source AS prompt FROM documents""",
)
def _(spark, d):
    features = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("home_language").alias("name"), F.col("lang").alias("value"))))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return _asked(spark, d).select("doc_id", dialogue.noise_prompt(F.coalesce(features, none), none, F.array(F.lit("typo"), F.col("source")), {}).alias("prompt"))


@query("t25_paraphrases")
def _(spark, d):
    said = dialogue.ask(_asked(spark, d).withColumn("prompt", F.concat(F.lit("PARAPHRASE\n"), "query")), dialogue.MockClient(empty_every=7), "prompt", "answer")
    return said.select("doc_id", F.when(F.col("answer") == "", F.col("query")).otherwise(F.col("answer")).alias("noisy"))


def _ids(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("persona_id"))
    return personas.spread(docs, docs.count(), "persona_id").distinct()


@query("t29_persona_prompts")
def _(spark, d):
    p = personas.sample_personas(_ids(spark, d), personas.default_bank(), "t29")
    return dialogue.formulate(p, dialogue.MockClient(), min_length=5).select("persona_id", "system_prompt")


@query("c05b_persona_batch")
def _(spark, d):
    p = personas.sample_personas(_ids(spark, d), personas.default_bank(), "c05b")
    made = dialogue.formulate(p, dialogue.MockClient(empty_every=3), min_length=5)
    return made.where("system_prompt <> ''").select(personas.persona_id(F.col("features")).alias("persona_key"), "system_prompt", F.size("features").alias("num_features"))


@query("t32_sorted_json", "SELECT doc_id, '{\"a\":\"' || lang || '\",\"b\":\"' || source || '\"}' AS body FROM documents")
def _(spark, d):
    entries = F.array_sort(F.map_entries(F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.col("lang"))))
    return table(spark, d, "documents").select("doc_id", F.to_json(F.map_from_entries(entries)).alias("body"))


@query("t34_convert_history", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'kept as it is' ELSE string_agg(CASE role WHEN 'assistant' THEN text || chr(10) WHEN 'user' THEN 'User: ' || text ELSE 'System: ' || text END, chr(10) ORDER BY turn) END AS body FROM conversations GROUP BY conv_id".replace("string_agg(", "regexp_replace(string_agg(").replace("ORDER BY turn)", "ORDER BY turn), '\\n+$', '')"))
def _(spark, d):
    plain = F.when(F.col("conv_id") % 2 == 0, F.lit("kept as it is"))
    return interactions(spark, d).select("conv_id", F.coalesce(plain, text.conversation_text(F.col("messages"))).alias("body"))


@query("c09_judged_rollouts")
def _(spark, d):
    said = dialogue.ask(_asked(spark, d).withColumn("prompt", F.concat(F.lit("JUDGE 1-5\n"), "query")), dialogue.MockClient(empty_every=9), "prompt", "answer", attempts=2)
    score = F.when(F.col("answer") != "", text.unit_score(F.col("answer")))  # no answer is no score
    return said.select("doc_id", arith.combined_reward(score, F.lit(1.0)).alias("r")).select("doc_id", F.round("r.total", 6).alias("total"), "r.failed")


@query("c10_optimise_with_fallback")
def _(spark, d):
    said = dialogue.ask(_asked(spark, d).withColumn("prompt", F.concat(F.lit("OPTIMISE\n"), "query")), dialogue.MockClient(empty_every=5), "prompt", "answer", attempts=1)
    clean = text.clean_output(F.col("answer"))
    return said.select("doc_id", F.when(clean == "", F.col("query")).otherwise(clean).alias("optimized_prompt"), (clean == "").alias("fell_back"))


@query("c12_scored_evaluation")
def _(spark, d):
    bench = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    base = dialogue.score_responses(bench, dialogue.MockClient(), "item_id", "query")
    fan = evaluation.fan_out(bench, [0, 1, 2], failed=[2]).withColumn("query", F.concat("query", F.lit(" v"), F.col("checkpoint").cast("string")))
    opt = dialogue.score_responses(fan, dialogue.MockClient(), "item_id", "query", "checkpoint")
    j = opt.withColumnRenamed("scores", "optimized_scores").join(base.withColumnRenamed("scores", "original_scores"), "item_id")
    return evaluation.checkpoint_summary(j, "checkpoint")


@query("m08_sft_weights", "SELECT doc_id, length(lang) + length(source) - 1 AS n_inputs, length(source)::DOUBLE AS weight_sum FROM documents")
def _(spark, d):
    x = arith.sft_datum(F.split("lang", ""), F.split("source", ""))
    return table(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", F.size("x.inputs").cast("bigint").alias("n_inputs"), F.aggregate("x.weights", F.lit(0.0), lambda a, v: a + v).alias("weight_sum"))


@query("m11_backoff", "SELECT event_id, 1 + event_id % 5 AS attempt, 0.5::DOUBLE * pow(2, event_id % 5) AS pause FROM events WHERE event_type = 'error'")
def _(spark, d):
    """The pause before each failed event is tried again."""
    failed = table(spark, d, "events").where("event_type = 'error'").select("event_id", (1 + F.col("event_id") % 5).alias("attempt"))
    return failed.withColumn("pause", F.lit(0.5) * F.pow(F.lit(2.0), F.col("attempt") - 1))


@query("p11_log_projection", "SELECT event_id, event_type AS kind, value AS reward FROM events")
def _(spark, d):
    states = F.array(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("secret"), F.array(F.struct(F.col("value").alias("reward"), F.col("props").alias("raw"))).alias("rollouts")))
    kept = table(spark, d, "events").select("event_id", F.explode(storage.project_log(states, ["kind"], ["reward"])).alias("s"))
    return kept.select("event_id", "s.kind", F.explode("s.rollouts").alias("r")).select("event_id", "kind", "r.reward")


@query(
    "k08_usage_of_calls",
    """WITH u AS (SELECT 2 * (1 + len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS i, 4 AS o FROM documents)
SELECT s.scope, s.name, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens
FROM u, (VALUES ('all', ''), ('module', 'greeting'), ('model', 'mock/mock')) s(scope, name) GROUP BY s.scope, s.name""",
)
def _(spark, d):
    asked = table(spark, d, "documents").select("doc_id", F.concat(F.lit("REPLY\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
    said = dialogue.ask(asked, dialogue.MockClient(), "prompt", "answer", usage="calls")
    return usage.totals(dialogue.usage_rows(said, dialogue.MockClient(), "greeting", "calls"))


@query(
    "j09_mean_distance",
    """WITH f AS (SELECT doc_id, unnest(['lang', 'source']) AS name, unnest([lang, source]) AS value FROM documents),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, sum((a.value IS DISTINCT FROM b.value)::INT) AS d FROM f a JOIN f b ON a.name = b.name AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT doc_id) FROM f) AS n, round(avg(d), 6) AS distance FROM p""",
)
def _(spark, d):
    feature = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).alias("value"))
    p = table(spark, d, "documents").select("doc_id", F.array(feature("lang"), feature("source")).alias("features"))
    return personas.mean_distance(p).select("n", F.round("distance", 6).alias("distance"))


@query(
    "c05_paid_once",
    """SELECT doc_id, 1::BIGINT AS runs_equal, (SELECT count(DISTINCT lang || source) FROM documents) AS calls, (SELECT sum(4)::BIGINT FROM (SELECT DISTINCT lang, source FROM documents)) AS input_tokens FROM documents""",
)
def _(spark, d):
    """Two runs of the same questions over all documents; the ledger's calls and tokens are those of the distinct prompts."""
    book = ledger.Ledger(f"{storage.checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}", buckets=16)
    asked = table(spark, d, "documents").select("doc_id", F.concat(F.lit("REPLY\n"), "lang", F.lit("-"), "source").alias("prompt"))
    first = storage.checkpointed(dialogue.ask(asked, dialogue.MockClient(), "prompt", "answer", ledger=book))
    again = storage.checkpointed(dialogue.ask(asked, dialogue.MockClient(), "prompt", "said", ledger=book)).select("doc_id", "said")
    paid = book.calls(spark).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    both = first.join(again, "doc_id").select("doc_id", (F.col("answer") == F.col("said")).cast("bigint").alias("runs_equal"))
    return both.join(F.broadcast(paid))
