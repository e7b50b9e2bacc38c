"""Message logs as tables and streams, and message tables of a given size."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.keys import key_for
from tidewire.functions.latency import publish_latency_us, whole_div
from tidewire.session import remove_at_exit, shared_folder

EXPAND_BLOCK = 1 << 20


def read_message_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def run_starts(sent: DataFrame) -> DataFrame:
    """(run_id, start_us): the first send of each run of a log of ``MESSAGES_SENT``."""
    return sent.groupBy("run_id").agg(F.min("send_us").alias("start_us"))


def relative_sends(sent: DataFrame, starts: DataFrame) -> DataFrame:
    """Sends as reports take them: times from the start of their run, and their latency."""
    placed = sent.join(starts, "run_id")
    latency = publish_latency_us(F.col("send_us") * F.lit(1000), F.col("ack_us") * F.lit(1000))
    return placed.select(
        "run_id", "worker", "producer_id", "topic", "partition", "seq", "key",
        F.octet_length("payload").cast("bigint").alias("bytes"),
        whole_div(F.col("send_us") - F.col("start_us"), 1000).alias("send_ms"),
        whole_div(F.col("ack_us") - F.col("start_us"), 1000).alias("ack_ms"),
        latency.alias("latency_us"),
        "status",
    )


def relative_receives(received: DataFrame, starts: DataFrame) -> DataFrame:
    """Deliveries of ``MESSAGES_RECEIVED`` with times from the start of their run."""
    start_ms = whole_div(F.col("start_us"), 1000)
    return received.join(starts, "run_id").select(
        "run_id", "worker", "topic", "partition", "subscription", "seq",
        F.col("payload_len").alias("bytes"),
        (F.col("publish_ms") - start_ms).alias("publish_ms"),
        (F.col("receive_ms") - start_ms).alias("receive_ms"),
    )


def stream_message_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same log as a stream, oldest files first; ``path`` is a folder or a pattern."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def lay_out(log: DataFrame, folder: str, part: Column, parts: int, order: str) -> str:
    """Write a log as one file for each number ``part`` (0 to ``parts`` - 1), sorted by ``order`` inside.

    The files' times rise with their numbers, so a stream of the folder takes them in that
    order. One scan and one shuffle; the driver handles file names only.
    """
    log.repartitionById(parts, part.cast("int")).sortWithinPartitions(order).write.parquet(folder)
    jvm = log.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(log.sparkSession._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(path) if f.getPath().getName().startswith("part-"))
    first = int(time.time() - len(names)) * 1000
    for number, name in enumerate(names):
        files.setTimes(jvm.org.apache.hadoop.fs.Path(path, name), first + 1000 * number, -1)
    return folder


def bucketed_log(messages: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """The messages as a table in the shared folder, bucketed and sorted by ``keys``.

    Logs that are laid out alike are joined on these keys without moving a row, as often as they are read. The number of
    buckets is the session's number of shuffle partitions if none is given. One task writes each bucket.
    """
    spark = messages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, name = shared_folder(spark, "bucketed"), f"log_{uuid.uuid4().hex}"
    writer = messages.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", folder).saveAsTable(name)
    remove_at_exit(spark, folder)
    return spark.table(name)


def stream_kafka_log(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Records of a broker, from the earliest offset; needs the connector package."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", "earliest")
        .load()
    )


def publish_to_kafka(
    messages: DataFrame, servers: str, checkpoint: str
) -> StreamingQuery:
    """Send (topic, key, payload) rows to a broker; needs the connector package."""
    return (
        messages.select("topic", "key", F.col("payload").alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def write_message_log(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish (topic, key, payload) rows: one directory per micro-batch.

    A batch that is attempted again replaces its own directory, so each row is
    published once.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def synthesize_messages(
    producers: DataFrame,
    *,
    count: Column,
    key_mode: str = "NO_KEY",
    payload: Column,
    spacing_ms: int,
    block: int = EXPAND_BLOCK,
) -> DataFrame:
    """``count`` messages for each row of ``producers`` (needs producer_id).

    ``seq`` is dense from 0 per producer. A producer with many messages is laid out
    in blocks that different tasks expand.
    """
    sized = producers.select("*", count.cast("bigint").alias("_count")).where("_count > 0")
    blocks = sized.withColumn(
        "_from",
        F.explode(F.sequence(F.lit(0).cast("bigint"), whole_div(F.col("_count") - 1, block))),
    ).withColumn("_from", F.col("_from") * F.lit(block))
    last = F.least(F.col("_from") + F.lit(block), F.col("_count")) - 1
    spread = blocks.repartition("producer_id", "_from")
    messages = spread.withColumn("seq", F.explode(F.sequence(F.col("_from"), last)))
    return messages.select(
        *producers.columns,
        "seq",
        key_for(key_mode, F.col("producer_id"), F.col("seq")).alias("key"),
        payload.alias("payload"),
        (F.col("seq") * F.lit(spacing_ms)).alias("send_ms"),
    )
