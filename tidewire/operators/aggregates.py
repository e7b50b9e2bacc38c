"""Counters, rates, backlog, worker merges and whole-run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import to_mb_per_s, us_to_ms, whole_div
from tidewire.operators.histograms import bucket_counts, latency_summary
from tidewire.operators.scan import DEFAULT_SPAN, Running, running

PERIOD_MS = 10_000
BYTES_TO_MB = 1e-6
HEADROOM = 1.20

COUNTERS = ("messages_sent", "bytes_sent", "messages_received", "bytes_received")


def period_of(at_ms: Column, period_ms: int = PERIOD_MS) -> Column:
    """The period of a time; times before the start have negative ones."""
    length = F.lit(period_ms).cast("bigint")
    return whole_div(at_ms - F.pmod(at_ms, length), period_ms)


def _side(rows: DataFrame, keys: Sequence[str], at_ms: str, size: str, side: str, period_ms: int):
    counted = rows.withColumn("period", period_of(F.col(at_ms), period_ms))
    return counted.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias(f"messages_{side}"),
        F.sum(F.col(size).cast("bigint")).alias(f"bytes_{side}"),
    )


def period_counters(
    sends: DataFrame,
    receives: DataFrame,
    keys: Sequence[str] = ("run_id",),
    *,
    sent_at: str = "send_ms",
    received_at: str = "receive_ms",
    size: str = "bytes",
    period_ms: int = PERIOD_MS,
) -> DataFrame:
    """Messages and bytes, sent and received, per group and period.

    Each side is reduced to one row per period before the two meet.
    """
    sent = _side(sends, keys, sent_at, size, "sent", period_ms)
    received = _side(receives, keys, received_at, size, "received", period_ms)
    return union_workers(sent, received).groupBy(*keys, "period").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    )


def union_workers(*parts: DataFrame) -> DataFrame:
    """Bag union of statistics from several workers; missing counters are NULL."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def period_rates(counters: DataFrame, period_ms: int = PERIOD_MS) -> DataFrame:
    """Message rates and throughputs (decimal MB/s) of period counters."""
    seconds = period_ms / 1000
    return counters.select(
        "*",
        (F.col("messages_sent") / F.lit(seconds)).alias("publish_rate"),
        to_mb_per_s(F.col("bytes_sent"), seconds).alias("publish_mb_per_s"),
        (F.col("messages_received") / F.lit(seconds)).alias("consume_rate"),
        to_mb_per_s(F.col("bytes_received"), seconds).alias("consume_mb_per_s"),
    )


def running_totals(
    counters: DataFrame,
    keys: Sequence[str] = ("run_id",),
    order: str = "period",
    *,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Lifetime totals up to each period, warm-up and probes included."""
    return running(
        counters,
        keys,
        order,
        {
            "total_sent": Running(F.col("messages_sent")),
            "total_received": Running(F.col("messages_received")),
        },
        span=span,
    )


def backlog(totals: DataFrame, subscriptions: Column, message_size: Column) -> DataFrame:
    """Messages (and bytes) sent to all subscriptions and not yet received."""
    messages = subscriptions * F.col("total_sent") - F.col("total_received")
    return totals.withColumn("backlog", messages).withColumn(
        "backlog_bytes", messages * message_size
    )


def latency_mean(messages: DataFrame, keys: Sequence[str], latency_us: str) -> DataFrame:
    return messages.groupBy(*keys).agg(us_to_ms(F.avg(latency_us)).alias("latency_avg"))


def run_latency(messages: DataFrame, keys: Sequence[str], latency_us: str) -> DataFrame:
    """Latency summary of whole runs; ``messages`` is already without warm-up."""
    return latency_summary(bucket_counts(messages, keys, latency_us), keys)


def mean_rates(
    rates: DataFrame, keys: Sequence[str], message_size: Column
) -> DataFrame:
    """Plain mean of the period rates, and the throughput of that rate."""
    means = rates.groupBy(*keys).agg(
        F.avg("publish_rate").alias("publish_rate"), F.avg("consume_rate").alias("consume_rate")
    )
    return means.withColumn(
        "publish_mb_per_s", F.col("publish_rate") * message_size * F.lit(BYTES_TO_MB)
    ).withColumn("consume_mb_per_s", F.col("consume_rate") * message_size * F.lit(BYTES_TO_MB))


def counter_totals(sends: DataFrame, receives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Messages sent and received per group; probes (``is_probe``) count here and
    nowhere else."""
    sent = sends.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sent"),
        F.count_if(F.col("is_probe")).alias("probes"),
    )
    received = receives.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_received"))
    return union_workers(sent, received).groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_sent", "probes", "total_received")]
    )


def merge_workers(
    stats: DataFrame, keys: Sequence[str], counters: Sequence[str] = COUNTERS
) -> DataFrame:
    """Sum counters over workers."""
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def key_frequency(messages: DataFrame, key: str = "key") -> DataFrame:
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def distinct_keys(messages: DataFrame, key: str = "key") -> DataFrame:
    """Number of draws and of distinct keys, counted over the per-key counts."""
    return key_frequency(messages.where(F.col(key).isNotNull()), key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("draws"), F.count(F.lit(1)).alias("distinct_keys")
    )


def last_offsets(records: DataFrame, offset: str, *extra: str) -> DataFrame:
    """Latest offset per (topic, partition), with columns of the record that holds it."""
    at_last = [F.max_by(c, offset).alias(c) for c in extra]
    return records.groupBy("topic", "partition").agg(F.max(offset).alias(offset), *at_last)


def axis_max(series: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Upper end of a chart's axis: the largest value plus a fifth."""
    return series.groupBy(*keys).agg((F.max(y) * F.lit(HEADROOM)).alias("axis_max"))


def op_stats(events: DataFrame, keys: Sequence[str], latency_us: str) -> DataFrame:
    """Count, sum and quantiles of operations, split by ``success``."""
    groups = [*keys, "success"]
    summary = latency_summary(bucket_counts(events, groups, latency_us), groups)
    return summary.select(
        *groups,
        F.col("messages").alias("events"),
        (F.col("recorded_us") / F.lit(1000)).cast("double").alias("total_ms"),
        *[c for c in summary.columns if c.startswith("latency_")],
    )


def send_summary(sends: DataFrame, keys: Sequence[str]) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return sends.groupBy(*keys).agg(
        failed.alias("failed"), (F.count(F.lit(1)) - failed).alias("succeeded")
    )


def period_stats(
    messages: DataFrame,
    keys: Sequence[str],
    at_ms: str,
    latency_us: str,
    size: str,
    *,
    period_ms: int = PERIOD_MS,
) -> DataFrame:
    """Counters, rates and latency of one side in a single pass over its messages."""
    groups = [*keys, "period"]
    placed = messages.withColumn("period", period_of(F.col(at_ms), period_ms))
    summary = latency_summary(bucket_counts(placed, groups, latency_us, size), groups)
    seconds = period_ms / 1000
    return summary.withColumn("rate", F.col("messages") / F.lit(seconds)).withColumn(
        "mb_per_s", to_mb_per_s(F.col("bytes"), seconds)
    )
