"""Samples, statistics, joins, windows and dataset preparation over conversations and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.functions.rand import shuffle_key
from dialoom.operators import prep, samples
from dialoom.plans.catalog import query
from dialoom.plans.inputs import INTER_SQL, N_PERSONAS, interactions, query_items, sql_shuffle, table
from dialoom.sources import keyed, storage


def _turns():
    return F.size(samples.user_prompts(F.col("messages"))).cast("bigint")


def _samples(spark, d):
    return samples.training_samples(interactions(spark, d)).withColumn("persona_id", F.col("sample_id") % N_PERSONAS)


@query("p03_training_samples", f"WITH {INTER_SQL} SELECT conv_id AS sample_id, prompts[1] AS initial_query, md5(array_to_string(prompts, chr(31))) AS trajectory_md5, n_messages AS n_messages, num_turns FROM inter")
def _(spark, d):
    return _samples(spark, d).select("sample_id", "initial_query", F.md5(F.array_join("prompt_trajectory", "\x1f")).alias("trajectory_md5"), F.size("full_conversation").cast("bigint").alias("n_messages"), "num_turns")


@query("p03_training_samples_short", f"WITH {INTER_SQL} SELECT conv_id AS sample_id, prompts[1] AS only_prompt, least(num_turns, 1) AS n_prompts, 0::BIGINT AS n_messages FROM inter")
def _(spark, d):
    s = samples.training_samples(interactions(spark, d), include_trajectory=False, include_full=False)
    return s.select("sample_id", F.get("prompt_trajectory", F.lit(0)).alias("only_prompt"), F.size("prompt_trajectory").cast("bigint").alias("n_prompts"), F.size("full_conversation").cast("bigint").alias("n_messages"))


@query("p04_prompt_trajectory", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS prompt_no, text AS prompt FROM conversations WHERE role = 'user'")
def _(spark, d):
    return interactions(spark, d).select("conv_id", F.posexplode(samples.user_prompts(F.col("messages"))).alias("prompt_no", "prompt")).withColumn("prompt_no", F.col("prompt_no").cast("bigint"))


@query("p05_role_content", "SELECT conv_id, md5(string_agg(role || '=' || text, chr(31) ORDER BY turn)) AS view_md5 FROM conversations GROUP BY conv_id")
def _(spark, d):
    return interactions(spark, d).select("conv_id", F.md5(F.array_join(F.transform(samples.role_content(F.col("messages")), lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\x1f")).alias("view_md5"))


@query("p06_normalise_items", "SELECT conv_id AS sample_id, CASE WHEN conv_id % 3 = 0 THEN 'sample' ELSE 'converted' END AS kind FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id")
def _(spark, d):
    k = F.col("conv_id") % 3
    items = interactions(spark, d).select(F.when(k == 0, F.col("conv_id")).alias("sample_id"), F.when(k == 1, F.col("conv_id")).alias("interaction_id"))
    return prep.normalise_items(items)


@query("p07_export_rows", f"WITH {INTER_SQL} SELECT conv_id::VARCHAR AS id, '{{\"slot\":\"' || persona_id || '\"}}' AS persona, prompts[1] AS original_query, conv_id % 2 = 0 AS conversation_ended, num_turns FROM inter")
def _(spark, d):
    s = _samples(spark, d).withColumn("ended", F.when(F.col("sample_id") % 2 == 0, "true").when(F.col("sample_id") % 3 == 0, "maybe"))
    return s.select(
        F.col("sample_id").cast("string").alias("id"),
        F.to_json(F.create_map(F.lit("slot"), F.col("persona_id").cast("string"))).alias("persona"),
        F.coalesce("initial_query", F.lit("")).alias("original_query"),
        F.coalesce(F.col("ended").try_cast("boolean"), F.lit(False)).alias("conversation_ended"),
        "num_turns",
    )


@query(
    "p08_role_utterances",
    "SELECT conv_id, coalesce(string_agg(text, chr(31) ORDER BY turn) FILTER (role = 'user'), '') AS users, coalesce(string_agg(text, chr(31) ORDER BY turn) FILTER (role = 'assistant'), '') AS assistants FROM conversations GROUP BY conv_id",
)
def _(spark, d):
    u = samples.utterances(F.transform("messages", lambda m: F.struct(F.concat(F.lit(" "), F.upper(m["role"])).alias("role"), m["content"].alias("content"))))
    return interactions(spark, d).select("conv_id", u.alias("u")).select("conv_id", F.array_join("u.user", "\x1f").alias("users"), F.array_join("u.assistant", "\x1f").alias("assistants"))


@query("p09_infer_turns", f"WITH {INTER_SQL} SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE num_turns END AS num_turns FROM inter")
def _(spark, d):
    return interactions(spark, d).select("conv_id", F.coalesce(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")), _turns()).alias("num_turns"))


@query("p10_messages_schema", "SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN turn END AS kept_turn FROM conversations")
def _(spark, d):
    built = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.struct(m["turn"].alias("turn")).alias("metadata")))
    rows = interactions(spark, d).select("conv_id", F.posexplode(built).alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", F.when(F.col("conv_id") % 2 == 0, F.col("m.metadata.turn")).alias("kept_turn"))


@query("p13_followups", "WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') SELECT conv_id, n, text FROM u WHERE n > 1")
def _(spark, d):
    return interactions(spark, d).select("conv_id", F.posexplode(samples.followups(F.col("messages"))).alias("p", "text")).select("conv_id", (F.col("p") + 2).cast("bigint").alias("n"), "text")


@query(
    "p17_feature_override",
    "SELECT doc_id, doc_id % 20 AS persona_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'general' END AS domain, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'casual' END AS scenario, 'mid' AS seniority FROM documents",
)
def _(spark, d):
    personas = spark.range(N_PERSONAS).select(F.col("id").alias("persona_id"), F.create_map(*[F.lit(x) for x in ("domain", "general", "scenario", "casual", "seniority", "mid")]).alias("features"))
    q = query_items(spark, d).select("doc_id", (F.col("doc_id") % N_PERSONAS).alias("persona_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("inferred_domain"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("inferred_scenario"))
    return prep.interaction_tasks(personas, q).select("doc_id", "persona_id", *[F.element_at("features", k).alias(k) for k in ("domain", "scenario", "seniority")])


@query(
    "p18_task_indices",
    "WITH q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS query_index, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id, query_index, dense_rank() OVER (ORDER BY f) AS persona_index FROM q",
)
def _(spark, d):
    return prep.indexed_tasks(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "query_index", "persona_index")


@query("p21_group_limit", "WITH f AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source ORDER BY f LIMIT 5) SELECT doc_id, source FROM documents SEMI JOIN f USING (source)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("f")).orderBy("f").limit(5).select("source")
    return docs.join(F.broadcast(first), "source", "left_semi")  # at most five rows


@query("a01_training_statistics", f"WITH {INTER_SQL} SELECT count(*) AS total_samples, avg(num_turns) AS avg_turns, min(num_turns) AS min_turns, max(num_turns) AS max_turns, count(DISTINCT persona_id) AS unique_personas, sum(len(prompts))::BIGINT AS total_prompts FROM inter")
def _(spark, d):
    return samples.statistics(_samples(spark, d))


@query("a01_statistics_of_none", "SELECT 0::BIGINT AS total_samples, 0::DOUBLE AS avg_turns, 0::BIGINT AS min_turns, 0::BIGINT AS max_turns, 0::BIGINT AS unique_personas, 0::BIGINT AS total_prompts")
def _(spark, d):
    return samples.statistics(_samples(spark, d).where("false"))


@query("a08_group_collect", f"WITH {INTER_SQL} SELECT persona_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS conv_ids FROM inter GROUP BY persona_id")
def _(spark, d):
    return prep.grouped(interactions(spark, d), "persona_id", "conv_id").select("persona_id", F.size("members").cast("bigint").alias("n"), F.array_join("members.conv_id", ",").alias("conv_ids"))


@query("a09_fewest_turns", f"WITH {INTER_SQL} SELECT persona_id, arg_min(conv_id, num_turns * 1000000000 + conv_id) AS target FROM inter GROUP BY persona_id")
def _(spark, d):
    return interactions(spark, d).groupBy("persona_id").agg(F.min_by("conv_id", F.struct(F.coalesce(_turns(), F.lit(0)), "conv_id")).alias("target"))


@query("w03_rank_in_persona", f"WITH {INTER_SQL} SELECT conv_id, persona_id, row_number() OVER (PARTITION BY persona_id ORDER BY num_turns, conv_id) AS rank FROM inter")
def _(spark, d):
    return interactions(spark, d).select("conv_id", "persona_id", _turns().alias("t")).select("conv_id", "persona_id", F.row_number().over(Window.partitionBy("persona_id").orderBy("t", "conv_id")).cast("bigint").alias("rank"))


@query("w05_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 + 1 AS batch_no FROM documents")
def _(spark, d):
    r = samples.ranked(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])
    return r.select("doc_id", (F.floor((F.col("rn") - 1) / 64) + 1).alias("batch_no"))


@query("w07_turn_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_no, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS exchange_no FROM conversations")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("message_no"), F.sum((F.col("role") == "user").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("exchange_no"))


_SO_FAR = "SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(31)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS so_far_md5 FROM conversations"


@query("w08_history_so_far", _SO_FAR)
def _(spark, d):
    """Each turn's history as a prefix of its conversation's one text, taken when it is read."""
    said = table(spark, d, "conversations")
    turns = samples.history_ends(said).join(samples.histories(said), "conv_id")
    return turns.select("conv_id", "turn", F.md5(F.substr("history", F.lit(1), F.col("upto").cast("int"))).alias("so_far_md5"))


@query("w08_history_sizes", "SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0)::BIGINT AS n_chars FROM conversations")
def _(spark, d):
    """How long each turn's history is, from the offsets alone."""
    return samples.history_ends(table(spark, d, "conversations")).withColumnRenamed("upto", "n_chars")


@query("w06_keep_first_text", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def _(spark, d):
    return samples.keep_first(table(spark, d, "documents").select("doc_id", "text"), [F.col("text")], "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("dd01_stored_ids", "WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ':' || lang WHEN 1 THEN 'hash:' || substr(sha1(source || ':' || text), 1, 16) ELSE lang || doc_id % 7 END AS query_id FROM documents) SELECT query_id, min(doc_id) AS doc_id FROM q GROUP BY query_id")
def _(spark, d):
    k = F.col("doc_id") % 3
    src = F.when(k == 2, "").otherwise(F.col("source"))
    qid = samples.stored_query_id(src, F.col("text"), F.when(k == 0, F.col("lang")).when(k == 2, F.concat("lang", (F.col("doc_id") % 7).cast("string"))))
    return samples.keep_first(query_items(spark, d).select("doc_id", qid.alias("query_id")), ["query_id"], "doc_id").select("query_id", "doc_id")


@query("d04_dataset_ids", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN source || ':' || doc_id ELSE 'hash:' || substr(sha1(source || ':' || doc_id || ':' || text), 1, 16) END AS query_id FROM documents")
def _(spark, d):
    even = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    return query_items(spark, d).select("doc_id", samples.dataset_query_id(F.col("source"), F.col("text"), F.col("doc_id"), F.lit("").cast("string"), even).alias("query_id"))


@query("dd02_composite_dedupe", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY CASE WHEN doc_id % 2 = 0 THEN 'q' || lang || (doc_id % 50) ELSE 't' || md5(text) END")
def _(spark, d):
    qid = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", (F.col("doc_id") % 50).cast("string")))
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return samples.keep_first(docs.withColumn("key", F.coalesce(F.concat(F.lit("q"), qid), F.concat(F.lit("t"), F.md5("text")))).select("doc_id", "key"), ["key"], "doc_id").select("doc_id")


@query("dd03_merge_dedupe", "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 10 <> 0 GROUP BY source, doc_id % 9 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat_ws("/", "source", (F.col("doc_id") % 9).cast("string"))).alias("sample_id"))
    return samples.keep_first(docs, ["sample_id"], "doc_id", bypass=F.col("sample_id") == "").select("doc_id")


@query("dd04_last_wins", "SELECT source, lang, max(doc_id) AS doc_id, min(doc_id) AS first_pos FROM documents GROUP BY source, lang")
def _(spark, d):
    return samples.keep_last(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@query("k01_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return storage.upsert(docs.where("doc_id % 2 = 0").withColumn("state", F.lit("old")), docs.where("doc_id % 3 = 0").withColumn("state", F.lit("new")), "doc_id")


@query("k02_delete_by_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return storage.without_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


def _keyed(spark, d):
    path = f"{storage.checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}"
    kept = keyed.KeyedTable.create(spark, path, "doc_id bigint, text string, state string", "doc_id", 16)
    docs = table(spark, d, "documents").select("doc_id", "text")
    kept.upsert(docs.where("doc_id % 2 = 0").withColumn("state", F.lit("old")))
    return kept, docs


@query("k01_keyed_upsert", "SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, d):
    """Documents written to a table by buckets of their key, and some of them written again."""
    kept, docs = _keyed(spark, d)
    kept.upsert(docs.where("doc_id % 3 = 0").withColumn("state", F.lit("new")))
    return kept.read().select("doc_id", F.md5("text").alias("text_md5"), "state")


@query("k02_keyed_delete", "SELECT doc_id, 'old' AS state FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    kept, _ = _keyed(spark, d)
    kept.delete(table(spark, d, "labels"))
    return kept.read().select("doc_id", "state")


@query("k05_append_first_wins", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return storage.append_first_wins(docs.where("doc_id % 2 = 0").withColumn("state", F.lit("old")), docs.where("doc_id % 3 = 0").withColumn("state", F.lit("new")), "doc_id")


@query("s07_catalogue", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return storage.index_of(table(spark, d, "documents"), "source")


@query("x01_split", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_shuffle('x01', 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r")
def _(spark, d):
    return samples.split(table(spark, d, "documents").select("doc_id"), "doc_id", "x01")


@query("x02_disjoint_subsets", f"WITH u AS (SELECT DISTINCT text FROM documents), r AS (SELECT text, row_number() OVER (ORDER BY {sql_shuffle('x02', 'text')}, text) AS rn FROM u) SELECT md5(text) AS text_md5, CASE WHEN rn <= 30 THEN 1 ELSE 2 END AS part FROM r WHERE rn <= 80")
def _(spark, d):
    return samples.disjoint_subsets(table(spark, d, "documents").select("text"), "text", "x02", 30, 50).select(F.md5("text").alias("text_md5"), "part")


@query("x03_epoch_shuffle", f"SELECT doc_id, e AS epoch, row_number() OVER (PARTITION BY e ORDER BY {sql_shuffle('x03', 'e', 'doc_id')}, doc_id) AS place FROM documents, range(2) t(e)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    parts = [samples.ranked(docs, [shuffle_key("x03", F.lit(e), "doc_id"), F.col("doc_id")], "place").select("doc_id", F.lit(e).cast("bigint").alias("epoch"), "place") for e in range(2)]
    return parts[0].unionByName(parts[1])


@query("o01_sorted_counts", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def _(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return samples.ranked(n, [-F.col("n"), F.col("source")], "place")


@query("o03_head_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("u01_union_all", "SELECT doc_id AS id, 0 AS file_ord FROM documents UNION ALL SELECT doc_id, 1 FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("file_ord")).unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("file_ord")))


@query("u02_set_union", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, d):
    lab = table(spark, d, "labels")
    return lab.where("quality = 0").select("doc_id").union(lab.where("toxic = 1").select("doc_id")).distinct()


@query("u03_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("u04_intersect", "SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, d):
    lab = table(spark, d, "labels")
    return lab.where("quality = 0").select("doc_id").intersect(lab.where("toxic = 1").select("doc_id"))


@query("j01_persona_queries", "SELECT p.persona_id, q.doc_id FROM range(15) p(persona_id) JOIN documents q ON q.doc_id % 20 = p.persona_id")
def _(spark, d):
    return spark.range(15).select(F.col("id").alias("persona_id")).join(query_items(spark, d).select((F.col("doc_id") % N_PERSONAS).alias("persona_id"), "doc_id"), "persona_id")


@query(
    "j02_ordered_history",
    f"""WITH {INTER_SQL}, h AS (SELECT persona_id, list(conv_id + CASE WHEN conv_id % 3 = 0 THEN 1000000000 ELSE 0 END ORDER BY conv_id)[1:4] AS ids FROM inter GROUP BY persona_id),
    x AS (SELECT persona_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM h)
    SELECT persona_id, string_agg(inter.conv_id || ':' || num_turns, ',' ORDER BY pos) AS history FROM x JOIN inter ON inter.conv_id = x.id GROUP BY x.persona_id""".replace("SELECT persona_id, string_agg", "SELECT x.persona_id, string_agg"),
)
def _(spark, d):
    inter = interactions(spark, d).select("conv_id", "persona_id", _turns().alias("num_turns"))
    wanted = inter.groupBy("persona_id").agg(F.array_sort(F.collect_list(F.struct("conv_id", (F.col("conv_id") + F.when(F.col("conv_id") % 3 == 0, 1_000_000_000).otherwise(0)).alias("id")))).alias("x")).select("persona_id", F.col("x.id").alias("ids"))
    return prep.history_of(wanted, "persona_id", "ids", inter.select(F.col("conv_id").alias("id"), F.concat_ws(":", "conv_id", "num_turns").alias("body")), 4).select("persona_id", F.array_join("history", ",").alias("history"))


@query("j03_unused_queries", "SELECT d.source AS dataset, d.doc_id::VARCHAR AS source_id FROM documents d WHERE d.source IN ('src1', 'src2', 'src3') AND d.doc_id % 11 <> 0 AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    q = query_items(spark, d).select(F.col("source").alias("dataset"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id").cast("string")).alias("source_id"))
    used = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("source_id"))
    return prep.unused(q.where(F.col("dataset").isin("src1", "src2", "src3")), used)


@query("j04_exclude_used", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "j05_available_queries",
    "SELECT doc_id, doc_id % 20 AS persona_id FROM documents WHERE doc_id % 20 NOT IN (3, 4) AND doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, d):
    q = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % N_PERSONAS).alias("persona_id"))
    used = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % N_PERSONAS).alias("persona_id"))
    unknown = spark.createDataFrame([(3,), (4,)], "persona_id bigint")
    return prep.available(q, used, unknown, "persona_id", "doc_id").select("doc_id", "persona_id")


@query("j06_disjoint_rows", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "benchmark").select("text"), "text", "left_anti").select("doc_id")


@query("j13_target_and_history", f"WITH {INTER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY num_turns, conv_id) AS rn FROM inter) SELECT t.persona_id, t.conv_id AS target, h.conv_id AS history FROM r t JOIN r h ON h.persona_id = t.persona_id AND h.conv_id <> t.conv_id WHERE t.rn = 1")
def _(spark, d):
    rows = interactions(spark, d).select("persona_id", "conv_id", _turns().alias("num_turns"))
    return prep.target_and_history(rows, "persona_id", "conv_id").select("persona_id", "target", F.col("conv_id").alias("history"))


C11_SQL = f"""WITH s AS (
  SELECT conv_id, conv_id % {N_PERSONAS} AS persona_id, count(*) FILTER (role = 'user') AS num_turns, min_by(text, turn) FILTER (role = 'user') AS query,
    string_agg(CASE role WHEN 'user' THEN '**User:** ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END
      WHEN 'assistant' THEN '**Assistant:** [Assistant responded]' END, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant')) AS body
  FROM conversations GROUP BY conv_id
), r AS (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY num_turns, conv_id) AS rn FROM s),
h AS (SELECT persona_id, conv_id, body, row_number() OVER (PARTITION BY persona_id ORDER BY conv_id) AS i FROM r WHERE rn > 1),
p AS (SELECT persona_id, count(*) AS n_hist, string_agg('### Conversation ' || i || chr(10) || chr(10) || body || chr(10) || chr(10) || '---', chr(10) || chr(10) ORDER BY i) FILTER (i <= 4) AS past FROM h GROUP BY persona_id),
t AS (SELECT r.persona_id, r.conv_id AS target_conv, coalesce(n_hist, 0) AS n_hist, query AS current_query,
  '{text.STATE_HEAD.replace("'", "''")}' || chr(10) || chr(10) || CASE WHEN past IS NULL THEN '' ELSE '## Historical Conversations' || chr(10) || chr(10) || past || chr(10) || chr(10) END
  || '## Current Query' || chr(10) || chr(10) || 'User: ' || query || chr(10) || chr(10) || replace('{text.STATE_TASK.replace(chr(10), "@@").replace("'", "''")}', '@@', chr(10)) AS state
  FROM r LEFT JOIN p USING (persona_id) WHERE rn = 1)
SELECT persona_id, target_conv, n_hist, current_query, md5(state) AS state_md5, length(state)::BIGINT AS prompt_length FROM t"""


@query("c11_optimise_dry_run", C11_SQL)
def _(spark, d):
    return prep.dry_run(interactions(spark, d), "persona_id", "conv_id", max_sessions=4, max_chars=500)


@query(
    "t06_history_text",
    f"""WITH s AS (SELECT conv_id, conv_id % {N_PERSONAS} AS persona_id, string_agg(CASE role WHEN 'user' THEN '**User:** ' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END ELSE '**Assistant:** [Assistant responded]' END, chr(10) ORDER BY turn) AS body
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY conv_id) AS i, count(*) OVER (PARTITION BY persona_id) AS n FROM s)
    SELECT persona_id, string_agg('### Session ' || i || ':' || chr(10) || body, chr(10) || chr(10) ORDER BY i) FILTER (i <= 3) || CASE WHEN max(n) > 3 THEN chr(10) || chr(10) || chr(10) || '(... ' || (max(n) - 3) || ' more sessions omitted for brevity)' ELSE '' END AS history FROM n GROUP BY persona_id""",
)
def _(spark, d):
    g = prep.grouped(interactions(spark, d).select("persona_id", "conv_id", text.session_text(F.col("messages"), 80).alias("body")), "persona_id", "conv_id")
    return g.select("persona_id", text.history_text(F.col("members.body"), F.lit(""), 3).alias("history"))


@query(
    "p12_success_chain",
    f"""WITH o AS (SELECT doc_id, doc_id % 7 <> 0 AS success, doc_id % 5 <> 0 AS parsed, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS q, CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS p, doc_id % 3 AS n_hist FROM documents)
    SELECT doc_id, q AS input_query, '<REASONING>r</REASONING><PROMPT>' || p || '</PROMPT>' AS output FROM o WHERE success AND parsed AND q <> '' AND n_hist >= 1 AND p <> ''""",
)
def _(spark, d):
    return prep.training_rows(_optimised(spark, d), min_history=1).select("doc_id", F.col("original_query").alias("input_query"), "output")


@query(
    "p12_skip_counts",
    """WITH o AS (SELECT doc_id % 7 <> 0 AS success, doc_id % 5 <> 0 AS parsed, doc_id % 11 <> 0 AS q, doc_id % 13 <> 0 AS p, doc_id % 3 >= 1 AS h FROM documents)
    SELECT count(*) AS total, count(*) FILTER (success AND parsed AND q AND NOT h) AS skipped, count(*) FILTER (success AND parsed AND q AND h AND p) AS kept FROM o""",
)
def _(spark, d):
    return prep.skip_counts(_optimised(spark, d), min_history=1)


def _optimised(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        (k % 7 != 0).alias("success"),
        (k % 5 != 0).alias("parse_success"),
        F.when(k % 11 == 0, "").otherwise(F.col("source")).alias("original_query"),
        F.when(k % 13 == 0, "").otherwise(F.col("lang")).alias("optimized_query"),
        F.lit("r").alias("reasoning"),
        (k % 3).alias("n_history"),
    )


@query("a16_optimise_summary", "SELECT count(*) FILTER (doc_id % 7 <> 0) AS success, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 2 = 1) AS failed, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 7 = 0) AS dry_run FROM documents")
def _(spark, d):
    df = table(spark, d, "documents").select((F.col("doc_id") % 7 != 0).alias("success"), ((F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 7 == 0)).alias("dry_run"))
    return df.agg(F.count_if("success").alias("success"), F.count_if(~F.col("success") & ~F.col("dry_run")).alias("failed"), F.count_if("dry_run").alias("dry_run"))


@query("a15_success_rate", f"WITH {INTER_SQL} SELECT count(*) AS total, round(100.0 * count(*) FILTER (num_turns >= 2) / count(*), 6)::DOUBLE AS success_pct, round(avg(num_turns), 6) AS avg_turns FROM inter")
def _(spark, d):
    df = interactions(spark, d).select(_turns().alias("t"))
    return df.agg(F.count("*").alias("total"), F.round(100.0 * F.count_if(F.col("t") >= 2) / F.nullif(F.count("*"), F.lit(0)), 6).alias("success_pct"), F.round(F.avg("t"), 6).alias("avg_turns"))


@query("a17_storage_statistics", "SELECT count(*) AS count, max(ts) AS last_updated FROM events")
def _(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("count"), F.max("ts").alias("last_updated"))


@query("a18_pipeline_stats", "SELECT count(*) AS total, count(CASE WHEN doc_id % 3 <> 0 THEN text END) AS with_prompts FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("total"), F.count(F.when(F.col("doc_id") % 3 != 0, F.col("text"))).alias("with_prompts"))


@query("a19_used_query_ids", "SELECT DISTINCT source || ':' || (doc_id % 40) AS query_id FROM documents WHERE doc_id % 6 <> 0")
def _(spark, d):
    return table(spark, d, "documents").select(F.when(F.col("doc_id") % 6 != 0, F.concat("source", F.lit(":"), (F.col("doc_id") % 40).cast("string"))).alias("query_id")).where("query_id IS NOT NULL").distinct()


@query("a10_success_summary", f"WITH {INTER_SQL} SELECT persona_id, count(*) AS n, count(DISTINCT CASE WHEN conv_id % 9 <> 0 THEN conv_id % 5 END) AS n_query_ids, bool_or(conv_id % 9 = 0) AS any_unknown FROM inter GROUP BY persona_id")
def _(spark, d):
    q = interactions(spark, d).select("persona_id", F.when(F.col("conv_id") % 9 != 0, F.col("conv_id") % 5).alias("query_id"))
    return prep.success_summary(q, "persona_id", "query_id").select("persona_id", "n", F.size("query_ids").cast("bigint").alias("n_query_ids"), "any_unknown")


@query("a11_deficit", f"WITH {INTER_SQL}, c AS (SELECT persona_id, count(*) AS n FROM inter GROUP BY persona_id) SELECT p.persona_id, 6 - coalesce(n, 0) AS needed FROM range(25) p(persona_id) LEFT JOIN c USING (persona_id) WHERE 6 - coalesce(n, 0) > 0")
def _(spark, d):
    counts = interactions(spark, d).groupBy("persona_id").agg(F.count("*").alias("n"))
    return prep.deficit(spark.range(25).select(F.col("id").alias("persona_id")), counts, "persona_id", 6)


@query("x04_quota_plan", f"WITH {INTER_SQL}, c AS (SELECT persona_id, count(*) AS done FROM inter GROUP BY persona_id) SELECT p.persona_id, greatest(0, 8 - coalesce(done, 0)) AS target_needed, least(greatest(0, 8 - coalesce(done, 0)), p.persona_id % 4) AS reuse, greatest(0, 8 - coalesce(done, 0)) - least(greatest(0, 8 - coalesce(done, 0)), p.persona_id % 4) AS generate FROM range(20) p(persona_id) LEFT JOIN c USING (persona_id)")
def _(spark, d):
    counts = interactions(spark, d).groupBy("persona_id").agg(F.count("*").alias("n"))
    p = spark.range(20).select(F.col("id").alias("persona_id"), (F.col("id") % 4).alias("available"))
    return prep.quota_plan(p, counts, "persona_id", 8)


@query("a07_usage_stats", "WITH u AS (SELECT d.doc_id, count(l.doc_id) AS uses FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id) SELECT count(*) AS total, count(*) FILTER (uses > 0) AS used, count(*) FILTER (uses = 0) AS unused, min(uses) FILTER (uses > 0) AS min_usage, max(uses) FILTER (uses > 0) AS max_usage, avg(uses) FILTER (uses > 0) AS avg_usage FROM u")
def _(spark, d):
    uses = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("uses"))
    return prep.usage_stats(table(spark, d, "documents").select("doc_id").join(uses, "doc_id", "left").select(F.coalesce("uses", F.lit(0)).alias("uses")))


@query("t07_state_text", f"WITH {INTER_SQL} SELECT conv_id, length('{text.STATE_HEAD}' || chr(10) || chr(10) || '## Current Query' || chr(10) || chr(10) || 'User: ' || prompts[1] || chr(10) || chr(10))::BIGINT + {len(text.STATE_TASK)} AS n_chars FROM inter")
def _(spark, d):
    none = F.array().cast("array<string>")
    return interactions(spark, d).select("conv_id", F.length(text.state_text(none, F.get(samples.user_prompts(F.col("messages")), F.lit(0)))).cast("bigint").alias("n_chars"))
