"""Registered streaming queries: each drains the events log, a file at a time, and returns a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import e2e_latency_us
from tidewire.operators.assign import transaction_batches
from tidewire.operators.filters import drop_warmup, positive_latency, successful_only
from tidewire.plans import recipes
from tidewire.plans.catalog.registry import (
    LATENCY_COLUMNS, PUBLISHED, RECV, SENT, bucket_sql, query,
    ranked_sql, rounded, summary_sql,
)
from tidewire.schemas import EVENTS
from tidewire.session import shared_folder
from tidewire.sources import message_log
from tidewire.streaming import hooks, live, pairing, stats, tables

RUN = ["run_id"]
SITTINGS = 4
EPOCH = recipes.EPOCH_MS


def _arrived(spark, sf_dir, part: str | None = None) -> str:
    """The events as a log of SITTINGS files, which a stream takes one at a time; ``part`` numbers them (else event order)."""
    events = recipes.table(spark, sf_dir, "events")
    if part is None:
        newest = events.agg((F.max("event_id") + 1).alias("end"))
        events = events.join(newest).withColumn("_part", F.expr(f"event_id * {SITTINGS} DIV end")).drop("end")
    else:
        events = events.withColumn("_part", F.expr(part))
    return message_log.lay_out(events, shared_folder(spark, "log"), F.col("_part"), SITTINGS, "event_id")


def _events(spark, log: str) -> DataFrame:
    return message_log.stream_message_log(spark, log, EVENTS, max_files_per_trigger=1)


def _at(column: str) -> Column:
    return F.timestamp_millis(F.col(column) + F.lit(EPOCH)).alias("event_time")


def _sends(spark, log: str) -> DataFrame:
    sent = recipes.send_columns(_events(spark, log))
    return sent.select("*", _at("send_ms"))


def _receives(spark, log: str) -> DataFrame:
    return recipes.receive_columns(_sends(spark, log)).select("*", _at("receive_ms"))


@query(
    "t1_stream_period_stats",
    f"""
    WITH {SENT}, published AS (
      SELECT run_id, 1704067200000 + send_ms // 10000 * 10000 AS period_ms, latency_us,
             {bucket_sql("latency_us")} AS bucket FROM sent WHERE status = 'ok'),
    ranked AS ({ranked_sql("published", "run_id, period_ms")})
    SELECT run_id, period_ms, count(*) AS messages, round(count(*) / 10.0::DOUBLE, 6) AS rate, {summary_sql()}
    FROM ranked GROUP BY run_id, period_ms""",
)
def t1_stream_period_stats(spark, sf_dir):
    """Statistics of every period; of those that are open when the log ends, what has come so far."""
    sent = successful_only(_sends(spark, _arrived(spark, sf_dir)))
    updates = tables.run_into_table(stats.period_buckets(sent, RUN), shared_folder(spark, "t1"), mode="update")
    buckets = tables.latest_by_key(updates, [*RUN, "period_ms", "bucket"])
    summary = stats.period_summary(buckets, RUN)
    columns = [*RUN, "period_ms", "messages", "rate", *LATENCY_COLUMNS]
    return rounded(summary.select(*columns), "rate", *LATENCY_COLUMNS)


@query(
    "t2_stream_control_windows",
    f"""
    WITH {RECV}, c AS (
      SELECT run_id, 1704067200000 + w * 3000 AS period_ms, CAST(sum(s) AS BIGINT) AS sent,
             CAST(sum(r) AS BIGINT) AS received, max(at_ms) AS at_ms FROM (
        SELECT run_id, send_ms // 3000 AS w, 1 AS s, 0 AS r, send_ms AS at_ms FROM sent WHERE status = 'ok'
        UNION ALL SELECT run_id, CAST(floor(receive_ms / 3000) AS BIGINT), 0, 1, receive_ms FROM recv) GROUP BY ALL)
    SELECT run_id, period_ms, sent, received,
      CASE WHEN sent / 3.0::DOUBLE < 0.9 * 0.95::DOUBLE THEN 'producer-bound'
           WHEN received / 3.0::DOUBLE < sent / 3.0::DOUBLE * 0.98::DOUBLE THEN 'consumer-bound' ELSE 'ok' END AS verdict
    FROM c WHERE period_ms + 3000 <= (SELECT max(at_ms) + 1704067200000 - 60000 FROM c)""",
)
def t2_stream_control_windows(spark, sf_dir):
    """Rates of all messages, in closed windows of 3 s."""
    log = _arrived(spark, sf_dir)
    counts = stats.control_counts(successful_only(_sends(spark, log)), _receives(spark, log), RUN)
    closed = tables.run_into_table(counts, shared_folder(spark, "t2"))
    judged = stats.control_verdicts(closed, F.lit(0.9), seconds=3.0)
    return judged.select(*RUN, "period_ms", "sent", "received", "verdict")


def _live(spark, sf_dir) -> DataFrame:
    log = _arrived(spark, sf_dir)
    rows = live.live_totals(successful_only(_sends(spark, log)), _receives(spark, log))
    return tables.run_into_table(rows, shared_folder(spark, "t3"), conf=live.state_settings(spark))


@query(
    "t3_stream_totals",
    f"""
    WITH {RECV}, s AS (SELECT run_id, count(*) AS total_sent FROM sent WHERE status = 'ok' GROUP BY 1),
    r AS (SELECT run_id, count(*) AS total_received FROM recv GROUP BY 1)
    SELECT run_id, total_sent, total_received, 3 * total_sent - total_received AS backlog
    FROM s JOIN r USING (run_id)""",
)
def t3_stream_totals(spark, sf_dir):
    """Totals of runs, added up from the changes that each worker has reported."""
    left = F.lit(recipes.SUBSCRIPTIONS) * F.col("total_sent") - F.col("total_received")
    return live.current_totals(_live(spark, sf_dir), RUN).withColumn("backlog", left)


@query(
    "t3_closed_totals",
    f"""
    WITH {RECV}, moved AS (
      SELECT run_id, worker, 1704067200000 + send_ms AS at_ms, 1 AS s, 0 AS r FROM sent WHERE status = 'ok'
      UNION ALL SELECT run_id, worker, 1704067200000 + receive_ms, 0, 1 FROM recv),
    periods AS (
      SELECT run_id, worker, at_ms // 10000 * 10000 AS period_ms, CAST(sum(s) AS BIGINT) AS sent,
             CAST(sum(r) AS BIGINT) AS received FROM moved GROUP BY ALL)
    SELECT run_id, worker, period_ms, sent, received,
           CAST(sum(sent) OVER (PARTITION BY run_id, worker ORDER BY period_ms) AS BIGINT) AS total_sent,
           CAST(sum(received) OVER (PARTITION BY run_id, worker ORDER BY period_ms) AS BIGINT) AS total_received
    FROM periods QUALIFY period_ms + 10000 <= (SELECT max(at_ms) - 60000 FROM moved)""",
)
def t3_closed_totals(spark, sf_dir):
    """Running totals of each worker, reported while the run goes on: one row for each period that has closed."""
    closed = _live(spark, sf_dir).where(F.col("kind") == live.CLOSED)
    return closed.withColumnRenamed("at_ms", "period_ms").drop("kind", "batch_id")


@query(
    "t4_stream_histogram",
    f"WITH {PUBLISHED} SELECT run_id, bucket, count(*) AS n FROM published GROUP BY run_id, bucket",
)
def t4_stream_histogram(spark, sf_dir):
    """The histogram of a run, reset at the end of warm-up."""
    kept = drop_warmup(successful_only(_sends(spark, _arrived(spark, sf_dir))), "send_ms")
    updates = tables.run_into_table(
        stats.run_histogram(kept, RUN), shared_folder(spark, "t4"), mode="update"
    )
    return tables.latest_by_key(updates, [*RUN, "bucket"]).select(*RUN, "bucket", "n")


@query(
    "t5_stream_send_ack",
    f"""
    WITH {SENT}, passed AS (
      SELECT least(max(send_ms), max(ack_ms) FILTER (WHERE seq % 23 <> 0)) - 10000 AS watermark FROM sent)
    SELECT seq, CASE WHEN seq % 23 <> 0 THEN (ack_ms - send_ms) * 1000 END AS latency_us,
           CASE WHEN seq % 23 <> 0 THEN 'answered' ELSE 'timed-out' END AS state
    FROM sent CROSS JOIN passed WHERE seq % 23 <> 0 OR send_ms + 60000 < watermark""",
)
def t5_stream_send_ack(spark, sf_dir):
    """Answered sends at once; those without an answer when the slower stream's watermark has passed their timeout."""
    log = _arrived(spark, sf_dir)
    sent = _sends(spark, log).select("producer_id", "producer_seq", "seq", "event_time")
    answered = recipes.send_columns(_events(spark, log)).where(F.col("seq") % 23 != 0)
    acks = answered.select("producer_id", "producer_seq", _at("ack_ms"))
    paired = tables.run_into_table(pairing.send_ack(sent, acks), shared_folder(spark, "t5"), conf=pairing.SLOWER_STREAM)
    state = F.when(F.col("acked_at").isNull(), "timed-out").otherwise("answered")
    return paired.select("seq", "latency_us", state.alias("state"))


@query(
    "t6_stream_e2e",
    f"""
    WITH {RECV}
    SELECT seq, subscription, CASE WHEN receive_ms > publish_ms THEN (receive_ms - publish_ms) * 1000 END
      AS latency_us
    FROM recv""",
)
def t6_stream_e2e(spark, sf_dir):
    received = _receives(spark, _arrived(spark, sf_dir))
    carried = pairing.carried_e2e(received).select("seq", "subscription", "latency_us")
    return tables.run_into_table(carried, shared_folder(spark, "t6")).drop("batch_id")


@query(
    "t6_stream_e2e_joined",
    f"""
    WITH {RECV}
    SELECT seq, subscription, CASE WHEN receive_ms > publish_ms THEN (receive_ms - publish_ms) * 1000 END
      AS latency_us
    FROM recv""",
)
def t6_stream_e2e_joined(spark, sf_dir):
    """The same latency when deliveries do not carry their publish time."""
    log = _arrived(spark, sf_dir)
    joined = pairing.joined_e2e(_sends(spark, log), _receives(spark, log))
    paired = tables.run_into_table(joined, shared_folder(spark, "t6j"), conf=pairing.SLOWER_STREAM)
    return paired.select("seq", "subscription", "latency_us")


RESENT = """
arrivals AS (
  SELECT producer_id, producer_seq, seq, send_ms + again * 1000 AS at_ms, again
  FROM sent CROSS JOIN (SELECT unnest([0, 2, 150]) AS again)
  WHERE again = 0 OR (again = 2 AND seq % 20 = 0) OR (again = 150 AND seq % 50 = 0))"""


@query(
    "t7_dedup",
    f"""
    WITH {SENT}, {RESENT},
    parts AS (SELECT *, at_ms * 4 // (SELECT max(at_ms) + 1 FROM arrivals) AS part FROM arrivals),
    passed AS (SELECT part + 2 AS part, max(max(at_ms)) OVER (ORDER BY part) - 10000 AS watermark FROM parts GROUP BY part)
    SELECT producer_id, producer_seq, p.at_ms FROM parts p LEFT JOIN passed USING (part)
    WHERE again = 0 OR (again = 150 AND seq * 360 + 10000 <= watermark)""",
)
def t7_dedup(spark, sf_dir):
    """A message that is sent again within 10 s goes; much later, when its state has gone, it counts as new."""
    again = F.when(F.col("seq") % 100 == 0, F.array(F.lit(0), F.lit(2), F.lit(150)))
    again = again.when(F.col("seq") % 50 == 0, F.array(F.lit(0), F.lit(150)))
    again = again.when(F.col("seq") % 20 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    sent = recipes.sends(spark, sf_dir).withColumn("again", F.explode(again))
    at = sent.select("producer_id", "producer_seq", (F.col("send_ms") + F.col("again") * 1000).alias("at_ms"))
    newest = at.agg((F.max("at_ms") + 1).alias("end"))
    parts = at.join(newest).withColumn("_part", F.expr(f"at_ms * {SITTINGS} DIV end")).drop("end")
    log = message_log.lay_out(parts, shared_folder(spark, "log"), F.col("_part"), SITTINGS, "at_ms")
    stream = message_log.stream_message_log(spark, log, at.schema, max_files_per_trigger=1)
    kept = pairing.drop_repeats_live(stream.select("*", _at("at_ms")), delay="10 seconds")
    return tables.run_into_table(kept.drop("event_time"), shared_folder(spark, "t7")).drop("batch_id")


def _consumed(spark, sf_dir, folder: str, stop_after: int | None = None) -> DataFrame:
    """The topics of all messages, consumed a file at a time, with the micro-batch of each."""
    topics = _topics(_events(spark, _arrived(spark, sf_dir)))
    if stop_after is not None:
        tables.some_batches(topics, f"{folder}/rows", f"{folder}/checkpoint", stop_after)
    tables.into_table(topics, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return tables.read_table(spark, f"{folder}/rows", topics.schema)


def _topics(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("event_type").alias("topic"))


@query(
    "t8_resume_from_offset",
    "SELECT event_type AS topic, count(*) AS messages, count(DISTINCT event_id) AS distinct_messages "
    "FROM events GROUP BY event_type",
)
def t8_resume_from_offset(spark, sf_dir):
    """Every message is consumed once although the query is stopped on its way and goes on from its checkpoint."""
    consumed = _consumed(spark, sf_dir, shared_folder(spark, "t8"), stop_after=1)
    return consumed.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("event_id").alias("distinct_messages")
    )


@query(
    "t9_transactional_sink",
    f"""
    WITH {SENT}, t AS (
      SELECT producer_id, producer_seq // 100 AS batch, count(*) AS events FROM sent GROUP BY ALL)
    SELECT producer_id, batch, events, CASE WHEN events = 100 THEN 'committed' ELSE 'aborted' END AS state
    FROM t""",
)
def t9_transactional_sink(spark, sf_dir):
    folder = shared_folder(spark, "t9")
    sent = _sends(spark, _arrived(spark, sf_dir)).select("producer_id", "producer_seq")
    tables.transactional_sink(sent, folder, f"{folder}/checkpoint").awaitTermination()
    committed = tables.read_committed(spark, folder, sent.schema)
    return transaction_batches(committed, "producer_id", "producer_seq", 100).drop("first_seq")


@query(
    "t10_drain",
    """
    WITH batches AS (
      SELECT event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS batch_id, count(*) AS n FROM events GROUP BY 1),
    totals AS (
      SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS total_received,
             CAST(sum(n) OVER () AS BIGINT) AS sent FROM batches)
    SELECT batch_id, total_received, sent - total_received AS backlog, sent - total_received <= 1000 AS drained
    FROM totals""",
)
def t10_drain(spark, sf_dir):
    """Backlog after each micro-batch: consumption is held between parts of the log."""
    consumed = _consumed(spark, sf_dir, shared_folder(spark, "t10"))
    waiting = recipes.table(spark, sf_dir, "events")
    return tables.drain_progress(consumed, waiting, drained_at=1000)


def _scopes() -> hooks.MetricScope:
    scope = hooks.MetricScope("benchmark")
    producer = scope.scope("producer")
    producer.counter("messages_sent")
    producer.counter("bytes_sent", F.col("bytes"))
    producer.outcomes("publish_us", F.col("latency_us"), F.col("status") == "ok")
    scope.scope("consumer").gauge("largest_seq", F.max("seq"))
    return scope


def _observed_sql(batch: str) -> str:
    counters = [
        ("messages_sent", "count(*)"), ("bytes_sent", "CAST(sum(bytes) AS BIGINT)"),
    ]
    for outcome, when in (("success", "status = 'ok'"), ("failure", "status <> 'ok'")):
        own = f"FILTER (WHERE {when})"
        counters += [
            (f"publish_us_{outcome}_count", f"count(*) {own}"),
            (f"publish_us_{outcome}_sum", f"CAST(coalesce(sum(latency_us) {own}, 0) AS BIGINT)"),
            (f"publish_us_{outcome}_max", f"coalesce(max(latency_us) {own}, 0)"),
        ]
        counters += [
            (f"publish_us_{outcome}_p{q}", f"coalesce(quantile_disc(latency_us, {q / 100}) {own}, 0)") for q in (50, 99)
        ]
    named = [(f"benchmark_producer_{n}", sql) for n, sql in counters] + [("benchmark_consumer_largest_seq", "max(seq)")]
    wide = ", ".join(f"{sql} AS {name}" for name, sql in named)
    return f"""
    WITH {SENT}, parts AS (SELECT *, {batch} AS batch_id FROM sent),
    wide AS (SELECT batch_id, {wide} FROM parts GROUP BY batch_id)
    UNPIVOT wide ON COLUMNS(* EXCLUDE batch_id) INTO NAME metric VALUE value"""


@query("t11_observe_counters", _observed_sql("seq * 4 // (SELECT max(seq) + 1 FROM sent)"))
def t11_observe_counters(spark, sf_dir):
    """Named statistics of every micro-batch, observed while its rows go by."""
    folder = shared_folder(spark, "t11")
    sent = recipes.send_columns(_events(spark, _arrived(spark, sf_dir)))
    observed = _scopes().observe(sent).select("seq")
    return hooks.observed_batches(observed, f"{folder}/rows", f"{folder}/checkpoint", f"{folder}/counters")


@query("u5_observed_scopes", _observed_sql("CAST(-1 AS BIGINT)"))
def u5_observed_scopes(spark, sf_dir):
    """The same statistics of a table, observed while it is written."""
    folder = shared_folder(spark, "u5")
    counters = hooks.observed_write(recipes.sends(spark, sf_dir), _scopes(), f"{folder}/rows")
    return hooks.counter_rows(spark, {-1: counters})


@query(
    "t12_late_rows",
    """
    WITH parts AS (SELECT event_id % 4 AS batch_id, event_id * 360 AS at_ms FROM events),
    passed AS (
      SELECT batch_id + 2 AS batch_id, max(max(at_ms)) OVER (ORDER BY batch_id) - 10000 AS watermark FROM parts GROUP BY batch_id)
    SELECT batch_id, 0 AS "operator", count(*) FILTER (WHERE at_ms <= watermark) AS dropped
    FROM parts LEFT JOIN passed USING (batch_id) GROUP BY batch_id""",
)
def t12_late_rows(spark, sf_dir):
    """Later parts of the log lie behind the watermark that the first part left."""
    folder = shared_folder(spark, "t12")
    events = _events(spark, _arrived(spark, sf_dir, part=f"event_id % {SITTINGS}"))
    at = F.timestamp_millis(F.lit(EPOCH) + F.col("event_id") * F.lit(recipes.SPACING_MS))
    timed = events.withColumn("event_time", at)
    kept = pairing.drop_repeats_live(timed, ["event_id"], delay="10 seconds").select("event_id")
    late = hooks.LateRows()
    spark.streams.addListener(late)
    try:
        query = tables.into_table(kept, f"{folder}/rows", f"{folder}/checkpoint")
        query.awaitTermination()
        return late.table(query).where(f"batch_id < {SITTINGS}")
    finally:
        spark.streams.removeListener(late)


@query(
    "s7_write_message_log",
    'SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS "key", props AS payload FROM events',
)
def s7_write_message_log(spark, sf_dir):
    folder = shared_folder(spark, "published")
    messages = _sends(spark, _arrived(spark, sf_dir)).select("topic", "key", "payload")
    message_log.write_message_log(messages, folder, f"{folder}-checkpoint").awaitTermination()
    return tables.read_table(spark, folder, messages.schema).drop("batch_id")


@query(
    "u2_message_callback",
    f"""
    WITH {RECV}
    SELECT subscription, count(*) AS messages,
           count(*) FILTER (WHERE receive_ms > publish_ms) AS recorded
    FROM recv GROUP BY subscription""",
)
def u2_message_callback(spark, sf_dir):
    """A callback that sees every micro-batch of deliveries and stores its own counts."""
    folder = shared_folder(spark, "u2")
    received = _receives(spark, _arrived(spark, sf_dir)).select("subscription", "publish_ms", "receive_ms")

    def message_received(batch: DataFrame, batch_id: int) -> None:
        us = positive_latency(e2e_latency_us(F.col("publish_ms"), F.col("receive_ms")))
        counts = batch.groupBy("subscription").agg(
            F.count(F.lit(1)).alias("messages"), F.count(us).alias("recorded")
        )
        counts.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    tables.for_each_batch(received, message_received, f"{folder}/checkpoint").awaitTermination()
    counts = spark.read.schema("subscription bigint, messages bigint, recorded bigint").parquet(
        f"{folder}/rows"
    )
    return counts.groupBy("subscription").agg(
        F.sum("messages").alias("messages"), F.sum("recorded").alias("recorded")
    )
