"""JSON of any shape, read in splits: arrays, single objects, objects one after another, on one line or many.

Spark's text reader cuts a file after each closing brace, so a file is read by
as many tasks as it has splits, whatever its line breaks. Whether a piece lies
inside a string and how deep it is nested follows from all that stands before
it. Each piece is counted for both cases, inside and outside a string; sums
over each split are chained by a window over the splits of a file, one row
each, and then hold for every piece. Pieces up to a brace that closes an item
are joined and parsed; plain values and arrays without an object are read with the
object behind them, and commas have to part them.

What cannot be parsed is a row with a null item and its length as unread, and
reading goes on behind it; so is an item beyond MAX_ITEM bytes or nested deeper
than Spark's parser allows. Nothing is lost without a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.sources.storage import checkpointed, json_values

#: An item of more bytes is left unread; what has no end cannot fill a task's memory.
MAX_ITEM = 1 << 28
#: Files with these endings are one split, and their last brace is taken to be there.
PACKED = r"\.(gz|bz2|lz4|snappy|deflate|zst|zstd)$"


def _depth(s: Column) -> Column:
    """Brackets that open less those that close."""
    return F.length(F.translate(s, "}]", "")) - F.length(F.translate(s, "{[", ""))


def _closed_first(s: Column) -> Column:
    """How many brackets from before a piece it closes; arrays of plain values in it are nested four deep at most."""
    s = F.regexp_replace(s, r"[^\[\]{}]", "")
    for _ in range(4):
        s = F.replace(s, F.lit("[]"), F.lit(""))
    return F.length(s) - F.length(F.ltrim(s, F.lit("]")))


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The pieces of files in order of (path, start, id), with what each does in both cases.

    quotes: unescaped quotes; out and inn: change of depth if it begins outside
    or inside a string, and out_first and inn_first what it closes before it
    opens anything; bytes: its length with the closing brace, if it has one.
    """
    rows = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece")
    )
    # a file's last piece has its brace if the lengths add up with it, or but for a byte order mark that was skipped
    size = F.octet_length("piece").cast("bigint")
    files = rows.groupBy("path").agg(F.sum(size + 1).alias("total"), F.max(F.struct("start", "id")).alias("end"), F.first("file_size").alias("file_size"))
    whole = F.col("total").isin(F.col("file_size"), F.col("file_size") - 3) | F.col("path").rlike(PACKED)
    open_ended = files.where(~whole).select("path", F.col("end.start").alias("start"), F.col("end.id").alias("id"), F.lit(False).alias("closed"))
    rows = rows.drop("file_size").join(open_ended, ["path", "start", "id"], "left").withColumn("closed", F.coalesce("closed", F.lit(True)))
    text = F.when(F.col("closed"), F.concat("piece", F.lit("}"))).otherwise(F.col("piece"))
    parts = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"', -1)
    every = lambda odd: F.array_join(F.filter("parts", lambda x, i: i % 2 == odd), "")
    rows = rows.withColumn("parts", parts).select(
        "path", "start", "id", "piece", "closed", (F.size("parts") - 1).alias("quotes"), _depth(every(0)).alias("out"), _depth(every(1)).alias("inn"), _closed_first(every(0)).alias("out_first"), _closed_first(every(1)).alias("inn_first"), (size + F.col("closed").cast("bigint")).alias("bytes")
    )
    return rows


def _chained(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces with running values within their split, for both cases of the split; and a row for each split with what stands before it."""
    here = Window.partitionBy("path", "start").orderBy("id")
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("flips", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).withColumn("array", (F.col("start") == 0) & (F.row_number().over(here) == 1) & F.ltrim("piece", F.lit(" \t\r\n")).startswith("["))
    turned = F.col("flips") == 1
    for case, plain, other in (("0", "out", "inn"), ("1", "inn", "out")):
        by = lambda suffix, a=plain, b=other: F.when(turned, F.col(b + suffix)).otherwise(F.col(a + suffix))
        rows = rows.withColumn("d" + case, F.sum(by("")).over(upto))
        low = F.when(by("_first") > 0, F.col("d" + case) - by("") - by("_first"))
        rows = rows.withColumn("low" + case, F.least("d" + case, low)).withColumn("least" + case, F.min(F.least("d" + case, low)).over(before))
    rows = checkpointed(rows.drop("out", "inn", "out_first", "inn_first").withColumn("upto", F.sum("bytes").over(upto)))
    splits = rows.groupBy("path", "start").agg(
        (F.sum("quotes") % 2).alias("odd"), F.max("array").alias("array"), F.sum("bytes").alias("bytes"), F.min("low0").alias("m0"), F.min("low1").alias("m1"), *[F.max_by(c, "id").alias(f"{c}_all") for c in ("d0", "d1")]
    )
    order = Window.partitionBy("path").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), zero) % 2).withColumn("offset", F.coalesce(F.sum("bytes").over(earlier), zero)).withColumn("array", F.max("array").over(Window.partitionBy("path")))
    own = lambda a, b: F.when(F.col("inside") == 1, F.col(b)).otherwise(F.col(a))
    splits = splits.withColumn("depth", F.coalesce(F.sum(own("d0_all", "d1_all")).over(earlier), zero))
    over = F.coalesce(F.max((F.col("depth") + own("m0", "m1") <= 0)).over(earlier), F.lit(False))
    return rows, splits.select("path", "start", "inside", "offset", "array", "depth", over.alias("over"))


def grouped(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Each piece with `at`, the offset behind it, and `item`, the offset behind the item that it belongs to (null: none ends it)."""
    rows = rows.drop("array").join(splits, ["path", "start"])
    own = lambda a, b: F.when(F.col("inside") == 1, F.col(b)).otherwise(F.col(a))
    # an array is over when its bracket is closed; what follows stands for itself
    low = F.least(own("least0", "least1"), F.when(own("low0", "low1") < own("d0", "d1"), own("low0", "low1")))
    over = F.col("over") | F.coalesce(F.col("depth") + low <= 0, F.lit(False))
    base = F.when(F.col("array") & ~over, 1).otherwise(0)
    outside = (F.col("inside") + F.col("flips") + F.col("quotes")) % 2 == 0
    ends = F.col("closed") & outside & (F.col("depth") + own("d0", "d1") <= base)
    rows = rows.select("path", "start", "id", "piece", "closed", "bytes", "array", (F.col("offset") + F.col("upto")).alias("at"), ends.alias("ends"))
    firsts = rows.where("ends").groupBy("path", "start").agg(F.min("at").alias("first"))
    following = Window.partitionBy("path").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = splits.select("path", "start").join(firsts, ["path", "start"], "left").withColumn("next", F.min("first").over(following)).select("path", "start", "next")
    rest = Window.partitionBy("path", "start").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.min(F.when(F.col("ends"), F.col("at"))).over(rest)
    return rows.withColumn("mine", mine).join(nexts, ["path", "start"]).withColumn("item", F.coalesce("mine", "next")).drop("mine", "next", "ends")


def json_items(spark: SparkSession, paths: str | list[str], max_item: int = MAX_ITEM) -> DataFrame:
    """(path, pos, item, unread): every item of the files, as JSON, in order of pos; and what could not be read."""
    rows = grouped(*_chained(pieces(spark, paths)))
    sizes = rows.groupBy("path", "item").agg(F.sum("bytes").alias("n"))
    huge = sizes.where(F.col("n") > max_item).select("path", F.coalesce("item", F.lit(-1)).alias("key"), F.lit(True).alias("huge"))
    rows = rows.withColumn("key", F.coalesce("item", F.lit(-1))).join(huge, ["path", "key"], "left")
    text = F.when(F.col("huge").isNull(), F.when(F.col("closed"), F.concat("piece", F.lit("}"))).otherwise(F.col("piece")))
    joined = rows.groupBy("path", "key").agg(
        F.min(F.col("at") - F.col("bytes")).alias("pos"),
        F.sum("bytes").alias("n"),
        F.max("array").alias("array"),
        F.max(F.coalesce("huge", F.lit(False))).alias("huge"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]), "").alias("text"),
    )
    space = r"^[\s,\]]*"
    first, last = F.col("array") & (F.col("pos") == 0), F.col("array") & (F.col("key") == -1)
    body = F.when(first, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.regexp_replace("text", space, ""))
    body = F.when(last, F.regexp_replace(body, r"[\s,]*\]\s*$", "")).otherwise(body)
    joined = joined.withColumn("body", F.trim(body, F.lit(" \t\r\n,"))).where("huge OR body <> ''")
    joined = joined.withColumn("values", F.when(~F.col("huge"), json_values(F.col("body"))))
    # a value by itself keeps its text
    one = F.struct(F.lit(0).cast("bigint").alias("k"), F.col("body").alias("item"), F.lit(0).cast("bigint").alias("unread"))
    many = F.transform("values", lambda v, k: F.struct(k.cast("bigint").alias("k"), F.to_json(v).alias("item"), F.lit(0).cast("bigint").alias("unread")))
    none = F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(None).cast("string").alias("item"), F.when(F.col("huge"), F.col("n")).otherwise(F.length("body")).cast("bigint").alias("unread"))
    found = F.when(F.col("values").isNull(), F.array(none)).when(F.size("values") == 1, F.array(one)).otherwise(many)
    return joined.select("path", "pos", F.explode(found).alias("x")).select("path", (F.col("pos") + F.col("x.k")).alias("pos"), "x.item", "x.unread")
