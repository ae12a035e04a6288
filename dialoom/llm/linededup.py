"""Line dedup: drop lines whose key occurs in many documents, except in one of them.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of at least min_chars code points in at least min_docs documents lose all
their lines except in the largest id that holds them. Column expressions only:
texts stay whole rows, and only (id, position, 128-bit key hash) is exploded.

Defined results: a null or empty text is one empty line; rows with a null id
hold and lose no counted line; documents with the same id count as one
document, and each row loses the lines at the positions dropped for its own
text; positions beyond the end of a shorter text of a repeated id are
nothing's; an empty table gives an empty one. Only the id and the text are
read, and other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import checkpointed

MIN_CHARS = 20
MIN_DOCS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """lower() is right for pure ASCII and much cheaper than translate()."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed_lines(docs: DataFrame, min_chars: int, text: str, id_col: str) -> DataFrame:
    """(doc_id, pos, h1, h2, first) for each line with a long key; first marks a key's first row in its document."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    hashed = F.transform(
        F.filter(lines, lambda x: F.length(x["key"]) >= min_chars),
        lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["pos"].alias("pos")),
    )
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.array_sort(hashed).alias("keys"))
    marked = F.transform("keys", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), ((i == 0) | (F.get("keys", i - 1)["h1"] != x["h1"]) | (F.get("keys", i - 1)["h2"] != x["h2"])).alias("first")))
    return rows.select("doc_id", F.explode(marked).alias("x")).select("doc_id", "x.*")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, drops): the positions of the lines that each losing document loses.

    The frequent keys are cut off by a checkpoint, so that both sides of the
    join on them are plain exchanges and a key of very many rows can be split.
    """
    keys = keyed_lines(docs, min_chars, text, id_col)
    frequent = checkpointed(
        keys.groupBy("h1", "h2")
        .agg(F.sum(F.col("first").cast("long")).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    lost = keys.join(frequent, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("pos").alias("drops"))


def _deduped(docs: DataFrame, min_chars: int, min_docs: int, text: str, id_col: str) -> DataFrame:
    """(row, lines, drops, kept): each row of docs as a struct, its lines, their dropped positions and its new text."""
    drops = dropped_lines(docs, min_chars, min_docs, text, id_col).select(F.col("doc_id").alias("i"), "drops")
    joined = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i")).join(drops, "i", "left")
    old = F.col("row").getField(text)
    split = joined.withColumn("lines", F.split(F.coalesce(old, F.lit("")), "\n", -1))
    # by a set of positions and not a search per line, so that a text of very many lines costs no more per line
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    placed = split.withColumn("stay", F.when(F.col("drops").isNotNull(), stay))
    kept = F.when(F.col("drops").isNull(), old).otherwise(F.array_join(F.transform("stay", lambda p: F.get("lines", p)), "\n"))
    return placed.select("row", F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of docs, the text without its dropped lines, plus n_lines and n_dropped in one struct line_dedup.

    Where docs has a column of that name, the struct's name ends in as many
    underscores as make it differ from all columns.
    """
    name = "line_dedup"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    out = _deduped(docs, min_chars, min_docs, text, id_col)
    cols = [F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols, F.struct("n_lines", "n_dropped").alias(name))


def line_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    d = _deduped(docs.select("doc_id", "text"), MIN_CHARS, MIN_DOCS, "text", "doc_id")
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_lines(docs: DataFrame, n_chars: str = "n_chars") -> DataFrame:
    """The columns of docs with the dropped lines gone from the text; a column of its length follows it."""
    out = _deduped(docs, MIN_CHARS, MIN_DOCS, "text", "doc_id")
    field = lambda c: F.col("row").getField(c)
    new = {"text": F.col("kept"), n_chars: F.when(F.col("n_dropped") > 0, F.length("kept").cast("bigint")).otherwise(field(n_chars))}
    return out.select(*[(new[c] if c in new else field(c)).alias(c) for c in docs.columns])
