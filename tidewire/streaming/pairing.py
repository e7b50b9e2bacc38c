"""Pairing live streams: sends with acknowledgements, publishes with deliveries, repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import PUBLISH_MAX_US, e2e_latency_us
from tidewire.operators.filters import positive_latency

ACK_TIMEOUT = "60 seconds"
#: State leaves when the slower of two streams has passed it, so no pair is lost while one is behind.
SLOWER_STREAM = {"spark.sql.streaming.multipleWatermarkPolicy": "min"}


def send_ack(
    sends: DataFrame, acks: DataFrame, *, delay: str = "10 seconds", timeout: str = ACK_TIMEOUT
) -> DataFrame:
    """Live publish latency; a send without an answer within the timeout comes out
    with NULLs once the watermark has passed it.

    Both sides carry (producer_id, producer_seq, event_time). State holds the
    messages in flight.
    """
    sent = sends.withWatermark("event_time", delay).withColumnRenamed("event_time", "sent_at")
    answered = acks.select(
        F.col("producer_id").alias("_pid"),
        F.col("producer_seq").alias("_pseq"),
        F.col("event_time").alias("acked_at"),
    ).withWatermark("acked_at", delay)
    in_time = F.expr(f"acked_at >= sent_at AND acked_at <= sent_at + INTERVAL {timeout}")
    same = (F.col("producer_id") == F.col("_pid")) & (F.col("producer_seq") == F.col("_pseq"))
    joined = sent.join(answered, same & in_time, "left_outer")
    latency = F.unix_micros("acked_at") - F.unix_micros("sent_at")
    capped = F.when(latency.isNotNull(), F.least(latency, F.lit(PUBLISH_MAX_US)))
    return joined.drop("_pid", "_pseq").withColumn("latency_us", capped)


def carried_e2e(receives: DataFrame) -> DataFrame:
    """End-to-end latency of deliveries that carry their publish time: no state at all."""
    latency = e2e_latency_us(F.col("publish_ms"), F.col("receive_ms"))
    return receives.withColumn("latency_us", positive_latency(latency))


def joined_e2e(
    sends: DataFrame, receives: DataFrame, *, delay: str = "10 seconds", limit: str = "12 hours"
) -> DataFrame:
    """End-to-end latency of deliveries that must be matched with their publish."""
    sent = sends.select(
        "topic", "partition", "seq", F.col("event_time").alias("sent_at")
    ).withWatermark("sent_at", delay)
    received = receives.select(
        F.col("topic").alias("_topic"), F.col("partition").alias("_partition"),
        F.col("seq").alias("_seq"), "subscription", F.col("event_time").alias("received_at"),
    ).withWatermark("received_at", delay)
    same = (
        (F.col("topic") == F.col("_topic"))
        & (F.col("partition") == F.col("_partition"))
        & (F.col("seq") == F.col("_seq"))
    )
    in_time = F.expr(
        f"received_at >= sent_at - INTERVAL {limit} AND received_at <= sent_at + INTERVAL {limit}"
    )
    latency = F.greatest(F.unix_micros("received_at") - F.unix_micros("sent_at"), F.lit(0))
    return sent.join(received, same & in_time).select(
        "topic", "partition", "seq", "subscription", positive_latency(latency).alias("latency_us")
    )


def drop_repeats(messages: DataFrame, ident: Sequence[str] = ("producer_id", "producer_seq")) -> DataFrame:
    """Batch: keep one copy of each message."""
    return messages.dropDuplicates(list(ident))


def drop_repeats_live(
    messages: DataFrame, ident: Sequence[str] = ("producer_id", "producer_seq"),
    *, delay: str = "1 hour",
) -> DataFrame:
    """Stream: drop copies that arrive within the watermark of the first."""
    return messages.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(ident))
