"""Analytic computations over period rows: deltas, verdicts, phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.scan import DEFAULT_SPAN, Running, previous, running

# Shares below which a side falls short, and the backlog that counts as drained.
PUBLISH_SHORTFALL = 0.95
CONSUME_SHORTFALL = 0.98
DRAINED_MESSAGES = 1000


def counter_delta(
    totals: DataFrame,
    keys: Sequence[str],
    at_ms: str,
    counters: Sequence[str],
    *,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Rate per second of each counter since the previous row; the first row has none."""
    seen = {f"_p_{c}": c for c in (at_ms, *counters)}
    lagged = previous(totals, keys, at_ms, seen, span=span)
    seconds = (F.col(at_ms) - F.col(f"_p_{at_ms}")) / F.lit(1000.0)
    rates = [((F.col(c) - F.col(f"_p_{c}")) / seconds).alias(f"{c}_rate") for c in counters]
    return lagged.where(F.col(f"_p_{at_ms}").isNotNull()).select(*totals.columns, *rates)


def sustain_verdict(publish_rate: Column, receive_rate: Column, target: Column) -> Column:
    return (
        F.when(publish_rate < target * F.lit(PUBLISH_SHORTFALL), F.lit("producer-bound"))
        .when(receive_rate < publish_rate * F.lit(CONSUME_SHORTFALL), F.lit("consumer-bound"))
        .otherwise(F.lit("ok"))
    )


def backlog_phases(
    totals: DataFrame,
    keys: Sequence[str],
    at_ms: str,
    *,
    requested_bytes: Column,
    drained_messages: int = DRAINED_MESSAGES,
) -> DataFrame:
    """When the backlog was first built up, and when it was first drained after that."""
    built = totals.groupBy(*keys).agg(
        F.min(F.when(F.col("backlog_bytes") >= requested_bytes, F.col(at_ms))).alias("built_ms")
    )
    low = totals.where(F.col("backlog") <= F.lit(drained_messages)).select(*keys, at_ms)
    drained = (
        low.join(built, list(keys))
        .where(F.col(at_ms) > F.col("built_ms"))
        .groupBy(*keys)
        .agg(F.min(at_ms).alias("drained_ms"))
    )
    return built.join(drained, list(keys), "left")


def ready_at(totals: DataFrame, keys: Sequence[str], at_ms: str, expected: Column) -> DataFrame:
    """First time at which every subscription of every topic can have received a message."""
    reached = F.when(F.col("total_received") >= expected, F.col(at_ms))
    return totals.groupBy(*keys).agg(F.min(reached).alias("ready_ms"))


def sample_seconds(position: Column, period_seconds: int = 10) -> Column:
    return position * F.lit(period_seconds)


def monotonic_ids(
    writes: DataFrame,
    keys: Sequence[str],
    order: str,
    clock: str,
    last_id: Column,
    *,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Time ids that never fall within a writer, starting at the writer's last id."""
    latest = running(writes, keys, order, {"_latest": Running(F.col(clock), "max")}, span=span)
    return latest.withColumn("tx_id", F.greatest(F.col("_latest"), last_id)).drop("_latest")
