"""Structured Streaming forms: running totals, late-data windows and append-only logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.operators import usage


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A source over a folder, or over one file; per_trigger bounds the files of a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).load(at.getParent().toString())
    return reader.load(path)


def running_module_totals(stream: DataFrame) -> DataFrame:
    """Totals of each module so far; for the complete or update mode."""
    return usage.by_module(stream)


def windowed_totals(stream: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Totals of each module and window; rows later than the watermark are left out, and windows are then final."""
    return usage.windowed(stream.withWatermark("ts", late), width)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls of each user in sessions that a gap ends."""
    g = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def append_log(stream: DataFrame, path: str, checkpoint: str, project: Callable[[DataFrame], DataFrame] | None = None, seconds: float | None = None):
    """Micro-batches appended as JSON lines; without an interval all that is there is written and the query ends.

    Each batch has a folder of its own and replaces it when tried again, so a
    restart doubles nothing.
    """

    def write(df: DataFrame, batch: int) -> None:
        (project(df) if project else df).write.mode("overwrite").json(f"{path}/batch={batch}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")
    return w.start()


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Persona batches through the stages: handle(df, batch) for each micro-batch that is there."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
