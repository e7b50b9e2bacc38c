"""The dashboard panels: each a composition of selection, look-back and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import label, series_label
from tidewire.operators.lookback import (
    Selector, avg_by, increase, instant, irate, select_series, sum_by,
)

SHORT_MS = 30_000
LONG_MS = 5 * 60_000

# Metric names without the area at their end.
HEAP = "jvm_memory_bytes_"
DIRECT = "jvm_memory_direct_bytes_"

CLIENT: Selector = ("group", "=~", "client")
REAL_DEVICE: Selector = ("device", "!~", "veth.*|lo")


def with_legend(points: DataFrame, template: str) -> DataFrame:
    return points.withColumn("legend", series_label(template, F.col("labels")))


def _client_rate(samples: DataFrame, metric: str) -> DataFrame:
    rates = irate(select_series(samples, metric, CLIENT), SHORT_MS)
    return with_legend(rates, "{{ instance }}")


def producer_msg_rate(samples: DataFrame) -> DataFrame:
    return _client_rate(samples, "benchmark_producer_messages_sent")


def consumer_msg_rate(samples: DataFrame) -> DataFrame:
    return _client_rate(samples, "benchmark_consumer_messages_recv")


def producer_byte_rate(samples: DataFrame) -> DataFrame:
    return _client_rate(samples, "benchmark_producer_bytes_sent")


def consumer_byte_rate(samples: DataFrame) -> DataFrame:
    return _client_rate(samples, "benchmark_consumer_bytes_recv")


def _latency_quantile(samples: DataFrame, metric: str, quantile: str) -> DataFrame:
    chosen = select_series(samples, metric, ("success", "=", "true"), ("quantile", "=", quantile))
    percent = f"{float(quantile) * 100:.0f}"
    return with_legend(instant(chosen), "{{ instance }} - " + percent + "%")


def produce_latency_q(samples: DataFrame, quantile: str) -> DataFrame:
    return _latency_quantile(samples, "benchmark_producer_produce_latency", quantile)


def e2e_latency_q(samples: DataFrame, quantile: str) -> DataFrame:
    return _latency_quantile(samples, "benchmark_consumer_e2e_latency", quantile)


def _family(samples: DataFrame, names: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """The samples of several metrics in several groups, for one look-back over all of them."""
    return samples.where(F.col("name").isin(*names) & label(F.col("labels"), "group").isin(*groups))


def _with_group(points: DataFrame) -> DataFrame:
    return points.withColumn("group", label(F.col("labels"), "group"))


def _with_area(points: DataFrame, prefix: str) -> DataFrame:
    return _with_group(points).withColumn("area", F.substring_index("name", prefix, -1))


def cpu_percent(samples: DataFrame, groups: Sequence[str]) -> DataFrame:
    rates = irate(_family(samples, ["process_cpu_seconds_total"], groups), SHORT_MS)
    percent = _with_group(rates).withColumn("value", F.col("value") * F.lit(100))
    return with_legend(percent, "{{instance}}")


def heap_sums(samples: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sums over all series of a group and area (committed, used, max)."""
    latest = instant(_family(samples, [HEAP + a for a in ("committed", "used", "max")], groups))
    return _with_area(latest, HEAP).groupBy("group", "area", "t_ms").agg(F.sum("value").alias("value"))


def direct_memory(samples: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Points of each series with group and area (used, max)."""
    return _with_area(instant(_family(samples, [DIRECT + a for a in ("used", "max")], groups)), DIRECT)


def gc_pause(samples: DataFrame, groups: Sequence[str]) -> DataFrame:
    grown = increase(_family(samples, ["jvm_gc_collection_seconds_sum"], groups), SHORT_MS)
    return _with_group(grown).groupBy("group", "t_ms").agg(F.sum("value").alias("value"))


def disk_bytes(samples: DataFrame, direction: str) -> DataFrame:
    """``direction`` is written or read."""
    rates = irate(select_series(samples, f"node_disk_{direction}_bytes_total"), LONG_MS)
    return with_legend(sum_by(rates, "group", "instance"), "{{group}} {{instance}}")


def network_bytes(samples: DataFrame, direction: str) -> DataFrame:
    """``direction`` is transmit or receive."""
    metric = f"node_network_{direction}_bytes_total"
    rates = irate(select_series(samples, metric, REAL_DEVICE), LONG_MS)
    return with_legend(rates, "{{group}} {{instance}} {{device}}")


def cpu_busy(samples: DataFrame) -> DataFrame:
    idle = irate(select_series(samples, "node_cpu_seconds_total", ("mode", "=", "idle")), LONG_MS)
    busy = avg_by(idle, "group", "instance").withColumn("value", F.lit(1.0) - F.col("value"))
    return with_legend(busy, "{{ group }} {{ instance }}")
