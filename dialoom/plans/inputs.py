"""The driver tables as the engine's entities, and small literals for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import samples

N_PERSONAS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as interactions; a persona holds those of one remainder."""
    return samples.interactions(table(spark, sf_dir, "conversations")).withColumn("persona_id", F.col("conv_id") % N_PERSONAS)


def query_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as queries: (query_id, doc_id, source, lang, text)."""
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit(":"), "doc_id").alias("query_id"), "doc_id", "source", "lang", "text")


#: The same for SQL: msgs and inter stand for messages and interactions.
INTER_SQL = f"""inter AS (
  SELECT conv_id, conv_id % {N_PERSONAS} AS persona_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS num_turns,
    list(text ORDER BY turn) FILTER (role = 'user') AS prompts FROM conversations GROUP BY conv_id
)"""


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '(?s)^\s+|\s+$', '', 'g')"


def sql_uniform(seed: str, *parts: str) -> str:
    key = f"'{seed}'" + "".join(f" || ':' || {p}::VARCHAR" for p in parts)
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT::DOUBLE + 1.0) / 4294967297.0)"


def sql_shuffle(seed: str, *parts: str) -> str:
    return f"md5('{seed}'" + "".join(f" || ':' || {p}::VARCHAR" for p in parts) + ")"


def sql_normal(seed: str, mean: float, std: float, *parts: str) -> str:
    return f"({mean}::DOUBLE + {std}::DOUBLE * sqrt(-2.0::DOUBLE * ln({sql_uniform(seed + '/r', *parts)})) * cos(6.283185307179586::DOUBLE * {sql_uniform(seed + '/a', *parts)}))"
