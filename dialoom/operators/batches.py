"""Arrow batches of bounded size between the JVM and Python."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, where the session leaves Spark's default.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about BATCH_BYTES in all columns; one row at least."""
    size = max(1, b.num_rows * BATCH_BYTES // max(b.nbytes, 1))
    for at in range(0, b.num_rows, size):
        yield b.slice(at, size)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """run over the Arrow batches of each task: what it sees at once is bounded by bytes, not by rows, and memory is given back at the end."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES) == "67108864b":
        conf.set(_BATCHES, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(part for b in batches for part in slices(b))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not the GNU C library
                pass

    return df.mapInArrow(bounded, schema)
