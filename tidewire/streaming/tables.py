"""Running streams into tables: keyed results, committed batches, callbacks, draining.

Every sink writes one directory per micro-batch and replaces it when the batch is
attempted again, so a lost executor or a restarted query never doubles a row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.scan import Running, running

COMMITS = "_committed"

BatchCallback = Callable[[DataFrame, int], None]


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold while a query is started (which copies them), and no longer."""
    old = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def for_each_batch(
    stream: DataFrame, callback: BatchCallback, checkpoint: str,
    *, mode: str = "append", conf: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Hand every micro-batch of what is available to ``callback``."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(callback)
    with settings(stream.sparkSession, conf or {}):
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(
    stream: DataFrame, path: str, checkpoint: str,
    *, mode: str = "append", conf: Mapping[str, str] | None = None,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return for_each_batch(stream, write, checkpoint, mode=mode, conf=conf)


def some_batches(stream: DataFrame, path: str, checkpoint: str, batches: int, seconds: float = 120.0) -> None:
    """Store at least ``batches`` micro-batches, and stop; the checkpoint says where to go on."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    deadline = time.monotonic() + seconds
    try:
        while query.isActive and len(query.recentProgress) < batches and time.monotonic() < deadline:
            time.sleep(0.05)
    finally:
        query.stop()


def run_into_table(
    stream: DataFrame, folder: str, *, mode: str = "append", conf: Mapping[str, str] | None = None
) -> DataFrame:
    """Drain a stream into a new table and return the table, with its batch ids."""
    into_table(stream, f"{folder}/rows", f"{folder}/checkpoint", mode=mode, conf=conf).awaitTermination()
    return read_table(stream.sparkSession, f"{folder}/rows", stream.schema)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows below ``path``; none when no micro-batch has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return _read_or_empty(spark, path, full)


def latest_by_key(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current value of each key of an update-mode table: that of its last batch."""
    values = [c for c in updates.columns if c not in keys and c != "batch_id"]
    last = F.max_by(F.struct(*values), F.col("batch_id")).alias("_last")
    return updates.groupBy(*keys).agg(last).select(*keys, "_last.*")


def transactional_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All-or-nothing batches: a batch counts once its commit record exists."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        commit = batch.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"))
        commit.write.mode("overwrite").parquet(f"{path}/{COMMITS}/{batch_id}")

    return for_each_batch(stream, write, checkpoint)


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    commit_schema = T.StructType([T.StructField("batch_id", T.LongType())])
    commits = _read_or_empty(spark, f"{path}/{COMMITS}/*", commit_schema)
    return read_table(spark, f"{path}/rows", schema).join(commits, "batch_id", "left_semi")


def drain_progress(consumed: DataFrame, sent: DataFrame, drained_at: int) -> DataFrame:
    """Backlog after each micro-batch of a drain, and whether it counts as drained.

    ``consumed`` is a table with batch ids, ``sent`` the rows that were waiting.
    Only one row per micro-batch is ordered.
    """
    per_batch = consumed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("received"))
    totals = running(per_batch, [], "batch_id", {"total_received": Running(F.col("received"))})
    left = sent.agg(F.count(F.lit(1))).scalar() - F.col("total_received")
    return totals.select(
        "batch_id", "total_received", left.alias("backlog"), (left <= drained_at).alias("drained")
    )
