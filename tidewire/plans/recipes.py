"""Message logs, configurations and metric samples derived from the supplied tables.

Each recipe is a projection of a table (with an explode where one row stands for
several), so scans stay pruned and every derived table grows with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.latency import whole_div
from tidewire.operators.lineage import stored
from tidewire.operators.scan import Running, running

SPACING_MS = 360
RUNS = 3
PARTITIONS = 4
WORKERS = 3
PRODUCERS = 8
SUBSCRIPTIONS = 3
EPOCH_MS = 1_704_067_200_000
SLOT_MS = 15_000
RESTART_SLOTS = 120

SYSTEMS = (
    "kafka", "pulsar", "rocketmq", "artemis", "nsq",
    "distributedlog", "rabbitmq", "nats-streaming", "nats", "stamped-stream",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def system_of(ident: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SYSTEMS])
    return F.element_at(names, (F.pmod(ident, F.lit(len(SYSTEMS))) + 1).cast("int"))


def send_columns(events: DataFrame) -> DataFrame:
    """One message per event on a dense clock; works on tables and streams."""
    eid = F.col("event_id")
    value_ms = long(F.round("value"))
    send_ms = eid * F.lit(SPACING_MS)
    return events.select(
        F.pmod(eid, F.lit(RUNS)).alias("run_id"),
        eid.alias("seq"),
        F.col("event_type").alias("topic"),
        F.pmod(eid, F.lit(PARTITIONS)).alias("partition"),
        F.pmod(whole_div(eid, RUNS), F.lit(WORKERS)).alias("worker"),
        F.pmod(eid, F.lit(PRODUCERS)).alias("producer_id"),
        whole_div(eid, PRODUCERS).alias("producer_seq"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("payload"),
        long(F.length("props")).alias("bytes"),
        send_ms.alias("send_ms"),
        F.when(eid % 97 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        long(F.round(F.col("value") * 1000)).alias("latency_us"),
        (send_ms + value_ms).alias("ack_ms"),
        value_ms.alias("value_ms"),
    )


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return send_columns(table(spark, sf_dir, "events"))


def receive_columns(sent: DataFrame) -> DataFrame:
    """Deliveries of successful sends to three subscriptions, some with a skewed clock and some missing."""
    each = sent.withColumn(
        "subscription", F.explode(F.array(*[long(i) for i in range(SUBSCRIPTIONS)]))
    )
    skew = F.when(F.col("seq") % 50 == 0, long(1000)).otherwise(long(0))
    arrived = F.col("send_ms") + F.col("value_ms") * (F.col("subscription") + 1) - skew
    delivered = (F.col("status") == "ok") & ((F.col("seq") + F.col("subscription")) % 41 != 0)
    return each.where(delivered).select(
        "run_id", "worker", "topic", "partition", "subscription", "seq", "bytes",
        F.col("send_ms").alias("publish_ms"), arrived.alias("receive_ms"),
    )


def receives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receive_columns(sends(spark, sf_dir))


def held_receives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries while consumers are paused for every second five minutes."""
    hold_ms = 300_000
    paused = whole_div(F.col("publish_ms"), hold_ms) % 2 == 1
    resumed = (whole_div(F.col("publish_ms"), hold_ms) + 1) * F.lit(hold_ms)
    held = F.when(paused, F.greatest(F.col("receive_ms"), resumed)).otherwise(F.col("receive_ms"))
    return receives(spark, sf_dir).withColumn("receive_ms", held)


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per send; some never come and some name another message."""
    sent = sends(spark, sf_dir).where(F.col("seq") % 23 != 0)
    answered = F.when(F.col("seq") % 29 == 0, F.col("seq") + 1).otherwise(F.col("seq"))
    return sent.select("producer_id", "producer_seq", answered.alias("ack_id"), "ack_ms")


def tag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations per channel: every tenth tag answers for all before it, every
    fourth for itself; a few refuse."""
    tag = F.col("producer_seq")
    covering = sends(spark, sf_dir).select(
        F.col("producer_id").alias("channel"),
        tag.alias("tag"),
        F.col("ack_ms").alias("at_ms"),
        (tag % 7 != 0).alias("positive"),
        F.inline(
            F.array_compact(
                F.array(
                    F.when(tag % 10 == 9, F.struct(F.lit(True).alias("multiple"))),
                    F.when(tag % 4 == 0, F.struct(F.lit(False).alias("multiple"))),
                )
            )
        ),
    )
    return covering


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload configurations, one per part."""
    part = table(spark, sf_dir, "part")
    return workload_columns(part, F.col("p_partkey"), F.col("p_name"), F.col("p_size"))


def workload_columns(rows: DataFrame, pk: Column, name: Column, size: Column) -> DataFrame:
    """A workload configuration for each row, by its number, name and size."""
    size = size.cast("bigint")

    def pick(column: Column, *values: object) -> Column:
        chosen = F.array(*[F.lit(v) for v in values])
        return F.element_at(chosen, (F.pmod(column, F.lit(len(values))) + 1).cast("int"))

    message_size = pick(pk, 100, 1024, 2727)
    return rows.select(
        F.format_string("%s-%06d", name, pk).alias("name"),
        pk.alias("workload_id"),
        (size % 5).alias("topics"),
        long(pick(size, 1, 1, 16, 100)).alias("partitions_per_topic"),
        pick(pk, "KEY_ROUND_ROBIN", "round-robin", "RANDOM_NANO", "NO_KEY", None).alias(
            "key_distributor"
        ),
        long(message_size).alias("message_size"),
        long(
            F.when(pk % 11 == 0, F.lit(None)).when(pk % 13 == 0, message_size + 1)
            .otherwise(message_size)
        ).alias("payload_length"),
        (pk % 3 + 1).alias("subscriptions_per_topic"),
        (pk % 2 + 1).alias("producers_per_topic"),
        (pk % 4).alias("consumer_per_subscription"),
        long(pick(pk, 50_000, 0, 10_000, -1, 2**31 - 1)).alias("producer_rate"),
        long(pick(pk, 0, 100, None)).alias("backlog_gb"),
        long(pick(pk, 15, 240, 5, None)).alias("test_duration_minutes"),
        F.when(pk % 17 == 0, F.lit("w1,w2")).alias("worker_list"),
        F.when(pk % 34 == 0, F.lit("workers.yaml")).alias("workers_file"),
        long(F.when(pk % 5 != 0, pk % 6)).alias("n_workers"),
    )


def sampled_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each worker at the end of each scrape slot.

    Worker 2 restarts every 120 slots, when its counters fall back to zero.
    """
    slot = whole_div(F.col("send_ms"), SLOT_MS)
    epoch = F.when(F.col("worker") == 2, whole_div(F.col("slot"), RESTART_SLOTS)).otherwise(long(0))
    per_slot = (
        sends(spark, sf_dir)
        .groupBy("worker", slot.alias("slot"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("bytes").alias("n_bytes"),
            F.max("latency_us").alias("worst_us"),
        )
        .withColumn("epoch", epoch)
    )
    counted = running(
        stored(per_slot),
        ["worker", "epoch"],
        "slot",
        {"total": Running(F.col("n")), "total_bytes": Running(F.col("n_bytes"))},
    )
    return counted.withColumn("ts_ms", (F.col("slot") + 1) * F.lit(SLOT_MS) + F.col("worker") * 1000)


# Metric name -> (column of the counters, extra label sets).
_GROUPS = ({}, {"group": "broker"}, {"group": "bookie"})

_METRICS: tuple[tuple[str, str, tuple[dict[str, str], ...]], ...] = (
    ("benchmark_producer_messages_sent", "total", ({},)),
    ("benchmark_producer_bytes_sent", "total_bytes", ({},)),
    ("benchmark_consumer_messages_recv", "total", ({},)),
    ("benchmark_consumer_bytes_recv", "total_bytes", ({},)),
    (
        "benchmark_producer_produce_latency", "worst_us",
        ({"success": "true", "quantile": "0.5"}, {"success": "true", "quantile": "0.99"},
         {"success": "false", "quantile": "0.5"}),
    ),
    (
        "benchmark_consumer_e2e_latency", "worst_us",
        ({"success": "true", "quantile": "0.5"}, {"success": "true", "quantile": "0.99"}),
    ),
    ("process_cpu_seconds_total", "total", _GROUPS),
    (
        "jvm_memory_bytes_committed", "n_bytes",
        tuple(g | {"area": area} for g in _GROUPS for area in ("heap", "nonheap")),
    ),
    ("jvm_memory_bytes_used", "n_bytes", _GROUPS),
    ("jvm_memory_bytes_max", "n_bytes", _GROUPS),
    ("jvm_memory_direct_bytes_used", "n_bytes", _GROUPS),
    ("jvm_memory_direct_bytes_max", "n_bytes", _GROUPS),
    (
        "jvm_gc_collection_seconds_sum", "total",
        tuple(g | {"gc": gc} for g in _GROUPS for gc in ("young", "old")),
    ),
    ("node_disk_written_bytes_total", "total_bytes", ({"device": "nvme0"}, {"device": "nvme1"})),
    ("node_disk_read_bytes_total", "total_bytes", ({"device": "nvme0"}, {"device": "nvme1"})),
    (
        "node_network_transmit_bytes_total", "total_bytes",
        ({"device": "eth0"}, {"device": "lo"}, {"device": "veth1"}),
    ),
    (
        "node_network_receive_bytes_total", "total_bytes",
        ({"device": "eth0"}, {"device": "lo"}, {"device": "veth1"}),
    ),
    ("node_cpu_seconds_total", "total", ({"mode": "idle"}, {"mode": "user"})),
)


def metric_samples(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Samples of the named metrics (of all that dashboards query, without names), one
    series per worker and label set."""
    instance = F.concat(F.lit("w"), F.col("worker").cast("string"))
    entries = [
        F.struct(
            F.lit(name).alias("name"),
            F.create_map(
                F.lit("instance"), instance,
                *[F.lit(x) for pair in ({"group": "client"} | extra).items() for x in pair],
            ).alias("labels"),
            F.col(column).cast("double").alias("value"),
        )
        for name, column, extras in _METRICS
        if not names or name in names
        for extra in extras
    ]
    return sampled_counters(spark, sf_dir).select("ts_ms", F.inline(F.array(*entries)))
