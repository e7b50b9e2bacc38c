"""Statistics of live message streams.

Streams carry ``event_time`` (a timestamp). Aggregations keep (window, bucket)
counts as state, which is bounded by the histogram's buckets; quantiles are read
off the counts afterwards, with the same functions as in batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import hdr_bucket
from tidewire.operators.histograms import latency_summary
from tidewire.operators.windows import sustain_verdict

DEFAULT_DELAY = "1 minute"


def period_buckets(
    messages: DataFrame,
    keys: Sequence[str],
    *,
    period: str = "10 seconds",
    delay: str = DEFAULT_DELAY,
) -> DataFrame:
    """Histogram counts per key and period, in update mode."""
    bucketed = messages.withColumn("bucket", hdr_bucket(F.col("latency_us")))
    counted = (
        bucketed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", period), *keys, "bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("bucket") - F.col("latency_us")).alias("deficit_us"),
            F.sum("bytes").alias("bytes"),
        )
    )
    start_ms = F.unix_millis("window.start").alias("period_ms")
    return counted.select(*keys, start_ms, "bucket", "n", "deficit_us", "bytes")


def period_summary(buckets: DataFrame, keys: Sequence[str], *, seconds: float = 10.0) -> DataFrame:
    """Rates and latency of the current counts."""
    stats = latency_summary(buckets, [*keys, "period_ms"])
    return stats.withColumn("rate", F.col("messages") / F.lit(seconds))


def control_counts(
    sends: DataFrame, receives: DataFrame, keys: Sequence[str],
    *, period: str = "3 seconds", delay: str = DEFAULT_DELAY,
) -> DataFrame:
    """Messages sent and received per control period, from two streams at once."""
    sent = sends.select(*keys, "event_time", F.lit(1).alias("s"), F.lit(0).alias("r"))
    received = receives.select(*keys, "event_time", F.lit(0).alias("s"), F.lit(1).alias("r"))
    counted = (
        sent.unionByName(received)
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", period), *keys)
        .agg(F.sum("s").alias("sent"), F.sum("r").alias("received"))
    )
    return counted.select(*keys, F.unix_millis("window.start").alias("period_ms"), "sent", "received")


def control_verdicts(counts: DataFrame, target, *, seconds: float) -> DataFrame:
    """Rates and verdict of each control period; ``target`` is a rate per second."""
    publish = F.col("sent") / F.lit(seconds)
    receive = F.col("received") / F.lit(seconds)
    return counts.withColumn("publish_rate", publish).withColumn("receive_rate", receive).withColumn(
        "verdict", sustain_verdict(F.col("publish_rate"), F.col("receive_rate"), target)
    )


def totals(sends: DataFrame, receives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lifetime totals per key, in update mode."""
    sent = sends.select(*keys, F.lit(1).alias("s"), F.lit(0).alias("r"))
    received = receives.select(*keys, F.lit(0).alias("s"), F.lit(1).alias("r"))
    return sent.unionByName(received).groupBy(*keys).agg(
        F.sum("s").alias("total_sent"), F.sum("r").alias("total_received")
    )


def run_histogram(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram that grows for the whole run, in update mode.

    Resetting it at the end of warm-up is a filter on the messages.
    """
    bucketed = messages.withColumn("bucket", hdr_bucket(F.col("latency_us")))
    return bucketed.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("bucket") - F.col("latency_us")).alias("deficit_us"),
        F.sum("bytes").alias("bytes"),
    )
