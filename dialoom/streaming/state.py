"""Runs watched as they go: arbitrary state per run, with a ring of the last steps, running totals, timers and an end.

The state of a run is its last few failure rates and its totals, a fixed size
whatever its length. The batch form over the same rows is
evaluation.watched_runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Steps give a `step` row each and, once in a run, an `abort` row; a step that comes after a later one a `late` row; a run that is idle an `end` row.
WATCHED = "run bigint, step bigint, event string, mean_rate double, tokens bigint"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunWatch(StatefulProcessor):
    """Follows each run by (step, rate, tokens, at)."""

    def __init__(self, width: int, limit: float, idle_ms: int):
        self.width, self.limit, self.idle_ms = width, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rates = handle.getListState("rates", "rate double")
        self.so_far = handle.getValueState("so_far", "last bigint, tokens bigint, aborted boolean, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        """A micro-batch's rows of a run, which are put in order of their steps."""
        new = pd.concat(list(rows), ignore_index=True).sort_values("step", kind="stable")
        last, tokens, aborted, timer = self.so_far.get() if self.so_far.exists() else (None, 0, False, None)
        late = new[new.step <= last] if last is not None else new[:0]
        new = new[new.step > last] if last is not None else new
        again = new.step.duplicated()
        late, new = pd.concat([late, new[again]]), new[~again]
        out = [pd.DataFrame({"step": late.step, "event": "late", "mean_rate": np.nan, "tokens": np.nan})]
        if len(new):
            held = [r[0] for r in self.rates.get()]
            rates = np.concatenate([held, new.rate.to_numpy(float)])
            total = np.concatenate([[0.0], np.cumsum(rates)])
            ends = np.arange(len(held), len(rates)) + 1
            begins = np.maximum(ends - self.width, 0)
            mean = (total[ends] - total[begins]) / (ends - begins)
            sums = tokens + np.cumsum(new.tokens.to_numpy(np.int64))
            out.append(pd.DataFrame({"step": new.step, "event": "step", "mean_rate": mean, "tokens": sums}))
            over = np.flatnonzero((ends - begins == self.width) & (mean > self.limit))
            if len(over) and not aborted:
                aborted = True
                out.append(out[-1].iloc[[over[0]]].assign(event="abort"))
            self.rates.put([(float(r),) for r in rates[-self.width :]])
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(int(new["at"].max().timestamp() * 1000) + self.idle_ms, timer or 0)
            self.handle.registerTimer(timer)
            self.so_far.update((int(new.step.iloc[-1]), int(sums[-1]), aborted, timer))
        yield self._named(key, pd.concat(out))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        """A run that has been idle is over; its state goes."""
        if self.so_far.exists():
            last, tokens, _, _ = self.so_far.get()
            held = [r[0] for r in self.rates.get()]
            yield self._named(key, pd.DataFrame({"step": [last], "event": "end", "mean_rate": [sum(held) / len(held)], "tokens": [tokens]}))
            self.so_far.clear()
            self.rates.clear()

    @staticmethod
    def _named(key, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(run=int(key[0]), tokens=rows.tokens.astype("Int64"))[["run", "step", "event", "mean_rate", "tokens"]]

    def close(self) -> None:
        pass


def watched_runs(stream: DataFrame, width: int = 5, limit: float = 0.8, idle: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """The events of runs, from a stream of (run, step, rate, tokens, at); see WATCHED.

    Within a micro-batch steps come in any order; a step before one that an
    earlier batch had is late and counts nowhere. The state store that this
    needs is set for the session.
    """
    stream.sparkSession.conf.set(_STATE_STORE, _ROCKS)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.select(F.col("run").cast("bigint").alias("run"), F.col("step").cast("bigint").alias("step"), F.col("rate").cast("double").alias("rate"), F.col("tokens").cast("bigint").alias("tokens"), F.col("at").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy("run").transformWithStateInPandas(RunWatch(width, limit, idle_ms), WATCHED, "Append", "EventTime")
