"""Totals of runs while they go on: state and timers for each run and worker.

Every (run, worker) keeps its lifetime totals and the counts of the periods that are still open. A change of the
totals comes out with the micro-batch that brought it. A period comes out once, when the watermark
passes its end, and so does a report that nothing has come for a while, be it that the watermark or the first message of a
later micro-batch shows it. State is a few
numbers for each (run, worker) and open period; a hot worker is read in Arrow batches, never held.

Open periods lie in blocks of ``BLOCK``, and the timer of the earliest one closes all that the watermark has passed, so
a micro-batch over many periods reads and writes blocks, not a value and a timer for each period.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.streaming.stats import DEFAULT_DELAY

#: The state store that keeps timers and several values for a key.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
#: Partitions of the state, at most: each has a store to commit in every micro-batch, whether keys lie there or not.
PARTITIONS = 32
CHANGED, CLOSED, IDLE = "changed", "closed", "idle"
PERIOD_MS = 10_000
IDLE_MS = 30_000
#: Periods of a block, and rows of (period, sent, received) that wait to be added up.
BLOCK = 4096
MOST_ROWS = 1 << 18

_COUNTS = T.StructType([T.StructField("sent", T.LongType()), T.StructField("received", T.LongType())])
_START = T.StructType([T.StructField("block_ms", T.LongType())])
_PERIODS = T.StructType([T.StructField("periods", T.BinaryType())])
_LAST = T.StructType([T.StructField("at_ms", T.LongType())])
#: ``at_ms``: the latest message of a change, the start of a closed period, or when silence began.
ROWS = "kind string, at_ms bigint, sent bigint, received bigint, total_sent bigint, total_received bigint"


def by_period(rows: np.ndarray) -> np.ndarray:
    """Rows of (period, sent, received), at least one, added up by period and in order."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
    return np.column_stack([rows[first, 0], np.add.reduceat(rows[:, 1:], first)])


class _Totals(StatefulProcessor):
    def __init__(self, keys: Sequence[str], period_ms: int, idle_ms: int) -> None:
        self.keys, self.period_ms, self.idle_ms = list(keys), period_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _COUNTS)
        self.closed = handle.getValueState("closed", _COUNTS)
        self.last = handle.getValueState("last", _LAST)
        self.open = handle.getMapState("open", _START, _PERIODS)

    def _rows(self, key: tuple, kind: str, *numbers: object) -> pd.DataFrame:
        """Rows of one kind from the numbers of ``ROWS``, each one value or an array."""
        values = [*key, kind, *map(np.atleast_1d, numbers)]
        return pd.DataFrame(dict(zip([*self.keys, *[c.split()[0] for c in ROWS.split(", ")]], values, strict=True)))

    def _block(self, start: int) -> np.ndarray:
        return np.frombuffer(self.open.getValue((start,))[0], "<i8").reshape(-1, 3)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        earliest, latest, found, held, most = None, last, [], 0, MOST_ROWS
        for batch in rows:
            batch = batch.dropna(subset="at_ms")
            if batch.empty:
                continue
            counts = batch[["at_ms", "sent", "received"]].to_numpy("<i8")
            low, high = int(counts[:, 0].min()), int(counts[:, 0].max())
            earliest = low if earliest is None else min(low, earliest)
            latest = high if latest is None else max(high, latest)
            counts[:, 0] = counts[:, 0] // self.period_ms * self.period_ms
            found.append(by_period(counts))
            held += len(found[-1])
            if held > most:
                found = [by_period(np.concatenate(found))]
                held, most = len(found[0]), max(MOST_ROWS, 2 * len(found[0]))
        if not found:
            return
        periods = by_period(np.concatenate(found))
        span = self.period_ms * BLOCK
        starts = periods[:, 0] // span * span
        for own in np.split(periods, np.flatnonzero(starts[1:] != starts[:-1]) + 1):
            start = int(own[0, 0]) // span * span
            if self.open.containsKey((start,)):
                own = by_period(np.concatenate([self._block(start), own]))
            self.open.updateValue((start,), (own.tobytes(),))
        self.handle.registerTimer(int(periods[0, 0]) + self.period_ms)
        new = periods[:, 1:].sum(axis=0).tolist()
        totals = self.totals.get() if self.totals.exists() else (0, 0)
        if last is not None and earliest > last + self.idle_ms:
            yield self._rows(key, IDLE, last, 0, 0, *totals)
        totals = (totals[0] + new[0], totals[1] + new[1])
        self.totals.update(totals)
        if latest != last:
            self.handle.registerTimer(latest + self.idle_ms)
            self.last.update((latest,))
        yield self._rows(key, CHANGED, latest, *new, *totals)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Close all periods that the watermark has passed; the earliest one left gets the next timer."""
        now, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for start in sorted(start for start, in self.open.keys()):
            own = self._block(start)
            over = int(np.searchsorted(own[:, 0], watermark - self.period_ms, side="right"))
            if over:
                before = self.closed.get() if self.closed.exists() else (0, 0)
                totals = np.cumsum(own[:over, 1:], axis=0) + np.array(before)
                self.closed.update(tuple(totals[-1].tolist()))
                yield self._rows(key, CLOSED, *own[:over].T, *totals.T)
            if over < len(own):
                if over:
                    self.open.updateValue((start,), (own[over:].tobytes(),))
                self.handle.registerTimer(int(own[over, 0]) + self.period_ms)
                break
            self.open.removeKey((start,))
        if self.last.exists() and self.last.get()[0] + self.idle_ms == now:
            yield self._rows(key, IDLE, now - self.idle_ms, 0, 0, *self.totals.get())

    def close(self) -> None:
        pass


def live_totals(
    sends: DataFrame, receives: DataFrame, keys: Sequence[str] = ("run_id", "worker"),
    *, period_ms: int = PERIOD_MS, idle_ms: int = IDLE_MS, delay: str = DEFAULT_DELAY,
) -> DataFrame:
    """The keys and ``ROWS`` of two streams with ``event_time``, to be started with ``STATE_STORE``.

    Timers of one key end in order of time, so the totals of closed periods are running totals.
    """
    def side(messages: DataFrame, sent: int) -> DataFrame:
        return messages.select(*keys, "event_time", F.lit(sent).alias("sent"), F.lit(1 - sent).alias("received"))

    timed = side(sends, 1).unionByName(side(receives, 0)).withWatermark("event_time", delay)
    at = timed.select(*keys, F.unix_millis("event_time").alias("at_ms"), "event_time", "sent", "received")
    kinds = ", ".join(f"{c} {sends.schema[c].dataType.simpleString()}" for c in keys)
    return at.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Totals(keys, period_ms, idle_ms),
        outputStructType=f"{kinds}, {ROWS}",
        outputMode="append",
        timeMode="EventTime",
    )


def state_settings(spark: SparkSession) -> dict[str, str]:
    """What a query of ``live_totals`` is started with."""
    partitions = min(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return STATE_STORE | {"spark.sql.shuffle.partitions": str(partitions)}


def current_totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals now, merged over everything but ``keys``: the changes of all (run, worker)s added up."""
    changes = rows.where(F.col("kind") == CHANGED)
    return changes.groupBy(*keys).agg(F.sum("sent").alias("total_sent"), F.sum("received").alias("total_received"))


def closed_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of closed periods, merged over everything but ``keys``."""
    closed = rows.where(F.col("kind") == CLOSED).groupBy(*keys, F.col("at_ms").alias("period_ms"))
    return closed.agg(F.sum("sent").alias("messages_sent"), F.sum("received").alias("messages_received"))
