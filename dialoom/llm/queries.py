"""The queries opN_<name> of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import alignment, chat, decontam, html, langid, linededup, lm, neardup, ngramjoin, packing, quality, repair, toxicity
from dialoom.llm.common import table

LOOP_TEXT = "</s>[INST] ok [/INST]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LOOP_TEXT).alias("text"))
    return chat.chat_digest(turns.unionByName(planted))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.languages(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), hashed=True)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digest(repair.damaged(table(spark, sf_dir, "conversations")), there=F.col("there"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_classes(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{LOOP_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{LOOP_TEXT}'
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END, '' ORDER BY turn, role, text) AS roles,
    sum(length('<|turn|>') + length(url_encode(role)) + 1 + length('<|end|>') + 1
      + length(text) + length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '[', ''))) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, 'S?U(AU)*A?') AS valid_order
FROM s
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


_JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+{k}-1], ' ') FOR i IN range(1, len(w) - {k} + 2)]) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), sym AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, sym.b FROM r JOIN sym ON sym.a = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id{kept}
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id
"""
OP7_SQL = _JOIN_SQL.format(k=5, percent=75, kept=", s.doc_id = c.component_id AS kept")
OP13_SQL = _JOIN_SQL.format(k=4, percent=85, kept="")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_decontamination": op2_decontamination,
        "op3_chat_format": op3_chat_format,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_lm_score": op9_lm_score,
        "op10_html_extraction": op10_html_extraction,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_structure_repair": op12_structure_repair,
        "op13_ngram_join": op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op13_ngram_join": OP13_SQL}
