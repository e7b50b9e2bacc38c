"""Spreading topics, consumers and events over workers, chunks and transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import whole_div
from tidewire.operators.scan import dense_index

_HASH_HEX_DIGITS = 15


def assign_round_robin(
    items: DataFrame, order: str, buckets: int, *, span: int | None = None
) -> DataFrame:
    """Item i goes to bucket i mod n; buckets beyond the items appear once, with NULLs.

    No items or no buckets give no rows.
    """
    if buckets <= 0:
        return items.withColumn("bucket", F.lit(None).cast("bigint")).where(F.lit(False))
    placed = dense_index(items, order, span=span).withColumn(
        "bucket", F.pmod(F.col("idx"), F.lit(buckets))
    )
    # Buckets are taken in order, so the empty ones are those from the item count on.
    counted = items.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(1, buckets - 1))
    empty = counted.select(F.explode(F.sequence(F.col("_n"), F.lit(buckets - 1))).alias("bucket"))
    return placed.drop("idx").unionByName(empty, allowMissingColumns=True)


def assign_chunks(
    items: DataFrame, order: str, *, size: Column, span: int | None = None
) -> DataFrame:
    """Contiguous chunks of ``size`` items; ``size`` may refer to ``idx`` and ``total``."""
    numbered = dense_index(items, order, total="total", span=span)
    return numbered.withColumn("chunk", whole_div(F.col("idx"), size))


def producers_per_chunk(processors: int) -> Column:
    """Chunk size that spreads all items over so many processors."""
    return whole_div(F.col("total") + F.lit(processors - 1), processors)


def worker_roles(workers: DataFrame, order: str, *, span: int | None = None) -> DataFrame:
    """First half of the workers produce, second half consume; an odd one is idle."""
    half = F.greatest(whole_div(F.col("total"), 2), F.lit(1))
    chunked = assign_chunks(workers, order, size=half, span=span)
    role = (
        F.when(F.col("chunk") == 0, F.lit("produce"))
        .when(F.col("chunk") == 1, F.lit("consume"))
        .otherwise(F.lit("idle"))
    )
    return chunked.withColumn("role", role).drop("chunk", "total")


def _counted(n: str) -> Column:
    """0 .. n-1, and nothing for n = 0."""
    upto = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(n), F.lit(1)).cast("bigint") - 1)
    return F.explode(F.when(F.col(n) > 0, upto))


def expand_consumers(workloads: DataFrame) -> DataFrame:
    """One row per topic, subscription and consumer of each workload."""
    per_topic = workloads.select("*", _counted("topics").alias("topic_idx"))
    per_subscription = per_topic.select("*", _counted("subscriptions_per_topic").alias("sub_idx"))
    return per_subscription.select("*", _counted("consumer_per_subscription").alias("consumer_idx"))


def expand_producers(workloads: DataFrame) -> DataFrame:
    """One row per producer and topic of each workload."""
    per_producer = workloads.select("*", _counted("producers_per_topic").alias("producer_idx"))
    return per_producer.select("*", _counted("topics").alias("topic_idx"))


def shuffle_assignments(items: DataFrame, ident: Sequence[str], seed: str) -> DataFrame:
    """Seeded random order as a position; the same seed gives the same order.

    Rows of equal draws are ordered by their identifiers.
    """
    text = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ident])
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, _HASH_HEX_DIGITS), 16, 10).cast("bigint")
    ranked = items.withColumn("_drawn", drawn)
    return dense_index(ranked, "_drawn", ties=ident, name="position").drop("_drawn")


def transaction_batches(events: DataFrame, producer: str, seq: str, size: int) -> DataFrame:
    """Transactions of ``size`` events per producer; one that never fills is aborted."""
    batch = whole_div(F.col(seq), size)
    full = F.when(F.col("events") == F.lit(size), F.lit("committed")).otherwise(F.lit("aborted"))
    return (
        events.groupBy(producer, batch.alias("batch"))
        .agg(F.count(F.lit(1)).alias("events"), F.min(seq).alias("first_seq"))
        .withColumn("state", full)
    )
