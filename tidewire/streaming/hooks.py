"""Live counters: named metrics observed on a stream, and what became of late rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewire.streaming.tables import into_table

Sink = Callable[[str, int, dict[str, object]], None]
QUANTILES = (50, 99)
QUANTILE_ACCURACY = 100_000


class MetricScope:
    """Named counters and gauges under a prefix; scopes nest."""

    def __init__(self, name: str = "") -> None:
        self.name = name
        self._metrics: dict[str, Column] = {}

    def scope(self, name: str) -> MetricScope:
        child = MetricScope(self._full(name))
        child._metrics = self._metrics
        return child

    def _full(self, name: str) -> str:
        return f"{self.name}_{name}" if self.name else name

    def counter(self, name: str, amount: Column | None = None) -> None:
        """Sum of ``amount`` over the rows, or their number."""
        value = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
        self._metrics[self._full(name)] = value

    def gauge(self, name: str, value: Column) -> None:
        """An aggregate read at the end of each micro-batch."""
        self._metrics[self._full(name)] = value

    def outcomes(self, name: str, value: Column, success: Column) -> None:
        """Count, sum, maximum and quantiles of whole numbers, of successes and of failures.

        Quantiles are values of the rank ceil(q * n), exact up to ``QUANTILE_ACCURACY`` rows, and off by n divided
        by it in rank beyond.
        """
        for outcome, when in (("success", success), ("failure", ~success)):
            own = F.when(when, value)
            scope = self.scope(f"{name}_{outcome}")
            scope.gauge("count", F.count(own))
            scope.gauge("sum", F.coalesce(F.sum(own), F.lit(0)))
            scope.gauge("max", F.coalesce(F.max(own), F.lit(0)))
            for q in QUANTILES:
                found = F.percentile_approx(own, q / 100, QUANTILE_ACCURACY)
                scope.gauge(f"p{q}", F.coalesce(found, F.lit(0)))

    def columns(self) -> list[Column]:
        return [v.alias(k) for k, v in self._metrics.items()]

    def observe(self, stream: DataFrame, name: str = "counters") -> DataFrame:
        return stream.observe(name, *self.columns())


class _Listener(StreamingQueryListener):
    """Knows which queries have ended, with all their reports in."""

    def __init__(self) -> None:
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended.add(str(event.runId))

    def wait_for(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        deadline = time.monotonic() + seconds
        while str(query.runId) not in self._ended:
            if time.monotonic() > deadline:
                raise TimeoutError("the query's end was not reported")
            time.sleep(0.05)


class CounterListener(_Listener):
    """Passes every micro-batch's observed counters to ``sink(query, batch, counters)``."""

    def __init__(self, sink: Sink, observation: str = "counters") -> None:
        super().__init__()
        self._sink = sink
        self._observation = observation

    def onQueryProgress(self, event) -> None:  # noqa: N802
        observed = event.progress.observedMetrics.get(self._observation)
        if observed is not None:
            self._sink(str(event.progress.id), event.progress.batchId, observed.asDict())


def counter_rows(spark: SparkSession, counters: dict[int, dict[str, object]]) -> DataFrame:
    """(batch_id, metric, value) of some micro-batches' metrics, which are whole numbers."""
    rows = [(batch, name, int(value)) for batch, own in sorted(counters.items()) for name, value in own.items()]
    return spark.createDataFrame(rows, "batch_id bigint, metric string, value bigint")


def observed_write(df: DataFrame, scope: MetricScope, path: str) -> dict[str, object]:
    """Write a table and return the metrics observed on the way."""
    observation = Observation("counters")
    df.observe(observation, *scope.columns()).write.parquet(path)
    return observation.get


def observed_batches(stream: DataFrame, path: str, checkpoint: str, counters: str, observation: str = "counters") -> DataFrame:
    """Drain an observed stream into a table, store the metrics of its micro-batches and return them.

    The metrics are computed in the query's own plan; the driver holds a few numbers for each micro-batch of a drain.
    """
    spark = stream.sparkSession
    seen: dict[int, dict[str, object]] = {}

    def keep(query: str, batch: int, found: dict[str, object]) -> None:
        if query == str(drained.id):
            seen[batch] = found

    drained: StreamingQuery
    listener = CounterListener(keep, observation)
    spark.streams.addListener(listener)
    try:
        drained = into_table(stream, path, checkpoint)
        drained.awaitTermination()
        listener.wait_for(drained)
    finally:
        spark.streams.removeListener(listener)
    rows = {batch: found for batch, found in seen.items() if any(value is not None for value in found.values())}
    counter_rows(spark, rows).write.mode("overwrite").parquet(counters)
    return spark.read.parquet(counters)


class LateRows(_Listener):
    """Keeps, for every micro-batch that ends, the rows behind the watermark of each operator.

    These are a few numbers for each micro-batch; unlike a query's own last progress
    reports they are complete.
    """

    def __init__(self) -> None:
        super().__init__()
        self._rows: dict[tuple[int, int], int] = {}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for i, operator in enumerate(event.progress.stateOperators):
            self._rows[event.progress.batchId, i] = operator.numRowsDroppedByWatermark

    def table(self, query: StreamingQuery, seconds: float = 60.0) -> DataFrame:
        """(batch_id, operator, dropped), once the query has ended and all its reports are in."""
        self.wait_for(query, seconds)
        rows = [(batch, operator, dropped) for (batch, operator), dropped in sorted(self._rows.items())]
        return SparkSession.active().createDataFrame(rows, "batch_id bigint, operator int, dropped bigint")
