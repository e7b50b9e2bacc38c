"""Row filters: successful sends, warm-up, test window, label and configuration checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.scan import DEFAULT_SPAN, Running, running

WARMUP_MS = 60_000
GIB = 1024**3

# What each system makes of a topic with other than one partition.
PARTITION_SUPPORT = {
    "kafka": "supported", "pulsar": "supported", "stamped-stream": "supported",
    "rocketmq": "supported", "distributedlog": "supported",
    "rabbitmq": "rejected", "artemis": "rejected",
    "nats": "ignored", "nats-streaming": "ignored", "nsq": "ignored",
}

# Fixed value: the largest percentile that charts show.
LARGEST_PERCENTILE = 99.999


def successful_only(sends: DataFrame) -> DataFrame:
    return sends.where(F.col("status") == "ok")


def positive_latency(latency_us: Column) -> Column:
    """Latency to record: values of zero are counted as messages but not recorded."""
    return F.when(latency_us > 0, latency_us)


def drop_warmup(rows: DataFrame, at_ms: str, run_start_ms: Column | int = 0) -> DataFrame:
    start = run_start_ms if isinstance(run_start_ms, Column) else F.lit(run_start_ms)
    return rows.where(F.col(at_ms) >= start + F.lit(WARMUP_MS))


def test_window(
    periods: DataFrame,
    keys: Sequence[str],
    period: str,
    *,
    period_ms: int,
    duration_ms: Column,
    draining: Column | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Periods up to the first that ends at or after the test's end while nothing drains.

    A duration of 0 leaves the test open-ended.
    """
    over = (duration_ms > 0) & ((F.col(period) + F.lit(1)) * F.lit(period_ms) >= duration_ms)
    if draining is not None:
        over = over & ~draining
    flagged = periods.withColumn("_over", over.cast("int"))
    ended = running(
        flagged, keys, period, {"_ended": Running(F.col("_over"), "sum")}, span=span
    )
    # keep every period before the end and the ending period itself
    kept = ended.where(F.col("_ended") - F.col("_over") == 0)
    return kept.drop("_over", "_ended")


def percentile_cutoff(curve: DataFrame, percentile: str = "percentile") -> DataFrame:
    return curve.where(F.col(percentile) <= F.lit(LARGEST_PERCENTILE))


def invalid_configs(workloads: DataFrame) -> DataFrame:
    """(workload, reason) for every rule a workload or its invocation breaks.

    Columns read: name, producer_rate, backlog_gb, message_size, payload_length
    (NULL when the payload file is missing), worker_list, workers_file, n_workers
    (NULL for a local run).
    """
    c = F.col
    problems = F.array(
        F.when((c("backlog_gb") > 0) & (c("producer_rate") == 0), F.lit("backlog with rate search")),
        F.when(c("worker_list").isNotNull() & c("workers_file").isNotNull(), F.lit("both worker options")),
        F.when(c("n_workers") <= 1, F.lit("too few workers")),
        F.when(c("payload_length").isNull(), F.lit("missing payload")),
        F.when(c("payload_length") != c("message_size"), F.lit("payload length mismatch")),
    )
    return workloads.select(c("name").alias("workload"), F.explode(F.array_compact(problems)).alias("reason"))


def unsupported_pairs(workloads: DataFrame) -> DataFrame:
    """(workload, system, effect) where a system does not do what the partition count asks."""
    systems = F.array(
        *[F.struct(F.lit(s).alias("system"), F.lit(e).alias("effect")) for s, e in PARTITION_SUPPORT.items()]
    )
    # one partition is a no-op on pulsar and normal elsewhere
    pairs = workloads.select(
        F.col("name").alias("workload"), F.col("partitions_per_topic"), F.inline(systems)
    )
    multi = F.col("partitions_per_topic") != 1
    no_op = (F.col("system") == "pulsar") & ~multi
    return pairs.where((multi & (F.col("effect") != "supported")) | no_op).select(
        "workload", "system", F.when(no_op, F.lit("no-op")).otherwise(F.col("effect")).alias("effect")
    )
