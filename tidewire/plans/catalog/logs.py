"""Registered filters, keys, assignments, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import keys, latency, text
from tidewire.operators import aggregates, assign, filters, histograms, joins, ordering, sketches, windows
from tidewire.operators.lineage import stored
from tidewire.plans import recipes, reports
from tidewire.plans.catalog.registry import (
    DELIVERED, DELIVERED_ONLY, HELD, LATENCY_COLUMNS, PUBLISHED, PUBLISHED_ONLY, RECV, SENT, bucket_sql, query,
    ranked_sql, rounded, summary_sql, token_sql,
)
from tidewire.plans.recipes import long, table
from tidewire.schemas import MESSAGES_RECEIVED, MESSAGES_SENT
from tidewire.session import shared_folder
from tidewire.sources import message_log
from tidewire.streaming import pairing

RUN = ["run_id"]
CONTROL_MS = 60_000
SUBSCRIPTIONS = recipes.SUBSCRIPTIONS
MESSAGE_SIZE = 9


# --- filters -------------------------------------------------------------------


@query(
    "f1_successful_only",
    f"""
    WITH {SENT} SELECT run_id, count(*) AS sent, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM sent WHERE status = 'ok' GROUP BY run_id""",
)
def f1_successful_only(spark, sf_dir):
    kept = filters.successful_only(recipes.sends(spark, sf_dir))
    return kept.groupBy(*RUN).agg(F.count(F.lit(1)).alias("sent"), F.sum("bytes").alias("bytes"))


@query(
    "f2_positive_latency",
    f"""
    WITH {RECV}
    SELECT run_id, subscription, count(*) AS messages,
           count(*) FILTER (WHERE receive_ms > publish_ms) AS recorded
    FROM recv GROUP BY run_id, subscription""",
)
def f2_positive_latency(spark, sf_dir):
    us = latency.e2e_latency_us(F.col("publish_ms"), F.col("receive_ms"))
    return (
        recipes.receives(spark, sf_dir)
        .groupBy(*RUN, "subscription")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.count(filters.positive_latency(us)).alias("recorded"),
        )
    )


@query(
    "f3_drop_warmup",
    f"""
    WITH {SENT}, totals AS (SELECT run_id, count(*) AS total FROM sent GROUP BY run_id),
    kept AS (SELECT run_id, count(*) AS n, min(send_ms) AS first_ms FROM sent
             WHERE send_ms >= 60000 GROUP BY run_id)
    SELECT run_id, n AS measured, first_ms, total FROM kept JOIN totals USING (run_id)""",
)
def f3_drop_warmup(spark, sf_dir):
    sent = recipes.sends(spark, sf_dir)
    measured = filters.drop_warmup(sent, "send_ms").groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("measured"), F.min("send_ms").alias("first_ms")
    )
    return measured.join(sent.groupBy(*RUN).agg(F.count(F.lit(1)).alias("total")), RUN)


@query(
    "f4_test_window",
    f"""
    WITH {SENT}, p AS (
      SELECT run_id, send_ms // 10000 AS period, count(*) AS messages FROM sent GROUP BY ALL),
    flagged AS (
      SELECT *, run_id > 0 AND (period + 1) * 10000 >= 600000 * run_id
                AND NOT (run_id = 2 AND period < 150) AS done FROM p),
    ended AS (SELECT run_id, min(period) AS last FROM flagged WHERE done GROUP BY run_id)
    SELECT run_id, period, messages FROM flagged LEFT JOIN ended USING (run_id)
    WHERE last IS NULL OR period <= last""",
)
def f4_test_window(spark, sf_dir):
    """Run 0 is open-ended, run 2 still drains after its end."""
    periods = (
        recipes.sends(spark, sf_dir)
        .groupBy(*RUN, aggregates.period_of(F.col("send_ms")).alias("period"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return filters.test_window(
        stored(periods), RUN, "period", period_ms=aggregates.PERIOD_MS,
        duration_ms=F.col("run_id") * F.lit(600_000),
        draining=(F.col("run_id") == 2) & (F.col("period") < 150),
    )


def _invalid_sql() -> str:
    size = "[100, 1024, 2727][CAST(p_partkey % 3 AS INTEGER) + 1]"
    return f"""
    WITH w AS (
      SELECT printf('%s-%06d', p_name, p_partkey) AS workload, p_partkey AS k, {size} AS size FROM part)
    SELECT workload, 'backlog with rate search' AS reason FROM w WHERE k % 3 = 1 AND k % 5 = 1
    UNION ALL SELECT workload, 'both worker options' FROM w WHERE k % 34 = 0
    UNION ALL SELECT workload, 'too few workers' FROM w WHERE k % 5 <> 0 AND k % 6 <= 1
    UNION ALL SELECT workload, 'missing payload' FROM w WHERE k % 11 = 0
    UNION ALL SELECT workload, 'payload length mismatch' FROM w WHERE k % 11 <> 0 AND k % 13 = 0"""


@query("f6_invalid_configs", _invalid_sql())
def f6_invalid_configs(spark, sf_dir):
    return filters.invalid_configs(recipes.workloads(spark, sf_dir))


@query(
    "f7_unsupported_pairs",
    """
    WITH w AS (
      SELECT printf('%s-%06d', p_name, p_partkey) AS workload,
             [1, 1, 16, 100][p_size % 4 + 1] AS parts FROM part)
    SELECT workload, unnest(['rabbitmq', 'artemis']) AS system, 'rejected' AS effect FROM w WHERE parts <> 1
    UNION ALL SELECT workload, unnest(['nats', 'nats-streaming', 'nsq']), 'ignored' FROM w WHERE parts <> 1
    UNION ALL SELECT workload, 'pulsar', 'no-op' FROM w WHERE parts = 1""",
)
def f7_unsupported_pairs(spark, sf_dir):
    return filters.unsupported_pairs(recipes.workloads(spark, sf_dir))


# --- keys, assignment, expansion -------------------------------------------------


def _keyed(spark, sf_dir, mode: str):
    key = keys.key_for(mode, F.col("producer_id"), F.col("producer_seq"))
    return recipes.sends(spark, sf_dir).select("producer_id", "producer_seq", key.alias("key"))


@query(
    "k1_key_none",
    f"WITH {SENT} SELECT producer_id, producer_seq, CAST(NULL AS VARCHAR) AS key FROM sent",
)
def k1_key_none(spark, sf_dir):
    return _keyed(spark, sf_dir, "NO_KEY")


@query(
    "k2_key_round_robin",
    f"""
    WITH {SENT}, drawn AS (
      SELECT producer_id, producer_seq,
             row_number() OVER (PARTITION BY producer_id ORDER BY producer_seq) % 10000 AS idx FROM sent)
    SELECT producer_id, producer_seq, {token_sql("keys", "idx", 7)} AS key FROM drawn""",
)
def k2_key_round_robin(spark, sf_dir):
    return _keyed(spark, sf_dir, "KEY_ROUND_ROBIN")


@query(
    "k3_key_random",
    f"""
    WITH {SENT}, drawn AS (
      SELECT producer_id, producer_seq,
             ('0x' || substr(sha256('0|' || producer_id || '|' || producer_seq), 1, 15))::BIGINT % 10000 AS idx
      FROM sent)
    SELECT producer_id, producer_seq, {token_sql("keys", "idx", 7)} AS key FROM drawn""",
)
def k3_key_random(spark, sf_dir):
    return _keyed(spark, sf_dir, "RANDOM_NANO")


@query(
    "k4_key_pool",
    f"""
    WITH drawn AS (SELECT DISTINCT event_id % 10000 AS idx FROM events)
    SELECT idx, {token_sql("keys", "idx", 7)} AS key FROM drawn""",
)
def k4_key_pool(spark, sf_dir):
    drawn = table(spark, sf_dir, "events").select((F.col("event_id") % keys.KEY_COUNT).alias("idx"))
    return drawn.distinct().withColumn("key", keys.pool_key(F.col("idx")))


@query(
    "k5_assign_round_robin",
    """
    WITH items AS (
      SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer),
    buckets AS (SELECT unnest(range(2000)) AS bucket)
    SELECT c_custkey, bucket FROM buckets LEFT JOIN items ON idx % 2000 = bucket""",
)
def k5_assign_round_robin(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select("c_custkey")
    return assign.assign_round_robin(items, "c_custkey", 2000)


@query(
    "k6_assign_chunks",
    """
    WITH items AS (
      SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx, count(*) OVER () AS n
      FROM customer)
    SELECT c_custkey, idx // ((n + 15) // 16) AS chunk FROM items""",
)
def k6_assign_chunks(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select("c_custkey")
    chunked = assign.assign_chunks(items, "c_custkey", size=assign.producers_per_chunk(16))
    return chunked.select("c_custkey", "chunk")


@query(
    "k6_worker_roles",
    """
    WITH workers AS (
      SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, count(*) OVER () AS n
      FROM supplier)
    SELECT s_suppkey, idx, CASE idx // (n // 2) WHEN 0 THEN 'produce' WHEN 1 THEN 'consume'
      ELSE 'idle' END AS role
    FROM workers""",
)
def k6_worker_roles(spark, sf_dir):
    return assign.worker_roles(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


@query(
    "k7_expand_consumers",
    """
    SELECT p_partkey AS workload_id, t.topic_idx, s.sub_idx, c.consumer_idx
    FROM part, LATERAL (SELECT unnest(range(p_size % 5)) AS topic_idx) t,
         LATERAL (SELECT unnest(range(p_partkey % 3 + 1)) AS sub_idx) s,
         LATERAL (SELECT unnest(range(p_partkey % 4)) AS consumer_idx) c""",
)
def k7_expand_consumers(spark, sf_dir):
    expanded = assign.expand_consumers(recipes.workloads(spark, sf_dir))
    return expanded.select("workload_id", "topic_idx", "sub_idx", "consumer_idx")


@query(
    "k7_expand_producers",
    """
    SELECT p_partkey AS workload_id, p.producer_idx, t.topic_idx
    FROM part, LATERAL (SELECT unnest(range(p_partkey % 2 + 1)) AS producer_idx) p,
         LATERAL (SELECT unnest(range(p_size % 5)) AS topic_idx) t""",
)
def k7_expand_producers(spark, sf_dir):
    expanded = assign.expand_producers(recipes.workloads(spark, sf_dir))
    return expanded.select("workload_id", "producer_idx", "topic_idx")


@query(
    "k8_shuffle_assignments",
    """
    SELECT c_custkey, row_number() OVER (
             ORDER BY ('0x' || substr(sha256('mix|' || c_custkey), 1, 15))::BIGINT) - 1 AS position
    FROM customer""",
)
def k8_shuffle_assignments(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select("c_custkey")
    return assign.shuffle_assignments(items, ["c_custkey"], "mix")


@query(
    "k9_transaction_batches",
    f"""
    WITH {SENT}
    SELECT producer_id, producer_seq // 100 AS batch, count(*) AS events,
           min(producer_seq) AS first_seq,
           CASE WHEN count(*) = 100 THEN 'committed' ELSE 'aborted' END AS state
    FROM sent GROUP BY producer_id, producer_seq // 100""",
)
def k9_transaction_batches(spark, sf_dir):
    return assign.transaction_batches(
        recipes.sends(spark, sf_dir), "producer_id", "producer_seq", 100
    )


# --- joins -----------------------------------------------------------------------


J1_SQL = f"""
WITH {SENT}
SELECT seq, CASE WHEN seq % 23 = 0 THEN 'pending' WHEN seq % 29 = 0 THEN 'failed'
  ELSE 'ok' END AS outcome,
  CASE WHEN seq % 23 <> 0 THEN ack_ms - send_ms END AS latency_ms
FROM sent"""


@query("j1_join_send_ack", J1_SQL)
def j1_join_send_ack(spark, sf_dir):
    sent = recipes.sends(spark, sf_dir).select("producer_id", "producer_seq", "seq", "send_ms")
    paired = joins.join_send_ack(sent, recipes.acks(spark, sf_dir))
    return paired.select("seq", "outcome", (F.col("ack_ms") - F.col("send_ms")).alias("latency_ms"))


@query("j1_bucketed_logs", J1_SQL)
def j1_bucketed_logs(spark, sf_dir):
    """Sends and answers that were laid out by producer: pairing them moves no rows."""
    keys = ["producer_id", "producer_seq"]
    sent = recipes.sends(spark, sf_dir).select(*keys, "seq", "send_ms")
    logs = [message_log.bucketed_log(log, keys) for log in (sent, recipes.acks(spark, sf_dir))]
    paired = joins.join_send_ack(*logs)
    return paired.select("seq", "outcome", (F.col("ack_ms") - F.col("send_ms")).alias("latency_ms"))


@query(
    "j2_join_cumulative_ack",
    f"""
    WITH {SENT}, answers AS (
      SELECT producer_id, producer_seq AS tag, ack_ms AS at_ms, producer_seq % 7 <> 0 AS positive,
             true AS multiple FROM sent WHERE producer_seq % 10 = 9
      UNION ALL
      SELECT producer_id, producer_seq, ack_ms, producer_seq % 7 <> 0, false
      FROM sent WHERE producer_seq % 4 = 0),
    settled AS (
      SELECT s.producer_id AS channel, s.producer_seq AS tag, min(a.at_ms) AS settled_ms
      FROM sent s JOIN answers a ON a.producer_id = s.producer_id
        AND (a.tag = s.producer_seq OR (a.multiple AND a.tag > s.producer_seq))
      GROUP BY ALL),
    refused AS (
      SELECT s.channel, s.tag, bool_or(NOT a.positive) AS refused
      FROM settled s JOIN answers a ON a.producer_id = s.channel AND a.at_ms = s.settled_ms
        AND (a.tag = s.tag OR (a.multiple AND a.tag > s.tag))
      GROUP BY ALL)
    SELECT m.producer_id AS channel, m.producer_seq AS tag, s.settled_ms,
           CASE WHEN s.settled_ms IS NULL THEN 'pending' WHEN r.refused THEN 'failed' ELSE 'ok' END AS outcome
    FROM sent m LEFT JOIN settled s ON s.channel = m.producer_id AND s.tag = m.producer_seq
    LEFT JOIN refused r ON r.channel = m.producer_id AND r.tag = m.producer_seq""",
)
def j2_join_cumulative_ack(spark, sf_dir):
    sent = recipes.sends(spark, sf_dir).select(
        F.col("producer_id").alias("channel"), F.col("producer_seq").alias("tag")
    )
    return joins.join_cumulative_ack(sent, recipes.tag_answers(spark, sf_dir))


J3_SQL = f"""
WITH {RECV}
SELECT s.seq, r.subscription, r.receive_ms - s.send_ms AS delay_ms
FROM sent s JOIN recv r USING (topic, "partition", seq)"""


@query("j3_join_publish_receive", J3_SQL)
def j3_join_publish_receive(spark, sf_dir):
    sent = recipes.sends(spark, sf_dir).select("topic", "partition", "seq", "send_ms")
    paired = joins.join_publish_receive(sent, recipes.receives(spark, sf_dir))
    delay = (F.col("receive_ms") - F.col("send_ms")).alias("delay_ms")
    return paired.select("seq", "subscription", delay)


@query("j3_bucketed_logs", J3_SQL)
def j3_bucketed_logs(spark, sf_dir):
    """Messages and deliveries that were laid out by topic, partition and number."""
    keys = ["topic", "partition", "seq"]
    sent = recipes.sends(spark, sf_dir).select(*keys, "send_ms")
    received = recipes.receives(spark, sf_dir).select(*keys, "subscription", "receive_ms")
    paired = joins.join_publish_receive(message_log.bucketed_log(sent, keys), message_log.bucketed_log(received, keys))
    return paired.select("seq", "subscription", (F.col("receive_ms") - F.col("send_ms")).alias("delay_ms"))


@query(
    "j4_fan_out",
    f"""
    WITH {SENT}, subscriptions AS (
      SELECT DISTINCT event_type AS topic, CAST(user_id % 3 AS BIGINT) AS subscription,
             CAST(user_id % 3 + 1 AS BIGINT) AS consumers FROM events)
    SELECT seq, subscription, "partition" % consumers AS consumer_id
    FROM sent JOIN subscriptions USING (topic)""",
)
def j4_fan_out(spark, sf_dir):
    third = F.col("user_id") % 3
    subscriptions = (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_type").alias("topic"),
            third.alias("subscription"),
            (third + 1).alias("consumers"),
        )
        .distinct()
    )
    sent = recipes.sends(spark, sf_dir).select("seq", "topic", "partition")
    return joins.fan_out(sent, subscriptions).select("seq", "subscription", "consumer_id")


DRIVERS = [
    {"driver": "kafka-sync", "system": "kafka"},
    {"driver": "artemis", "system": "artemis"},
    {"driver": "pulsar", "system": "pulsar"},
]

_MATRIX_SQL = """
    SELECT printf('%s-%06d', p_name, p_partkey) AS workload, d.pos AS driver_pos, d.driver
    FROM part, (VALUES (0, 'kafka-sync'), (1, 'artemis'), (2, 'pulsar')) d(pos, driver)"""


@query("j5_run_matrix", _MATRIX_SQL)
def j5_run_matrix(spark, sf_dir):
    named = recipes.workloads(spark, sf_dir).select(F.col("name").alias("workload"))
    return joins.run_matrix(named, DRIVERS).select("workload", "driver_pos", "driver")


@query("o1_order_runs", _MATRIX_SQL + " ORDER BY workload, driver_pos")
def o1_order_runs(spark, sf_dir):
    return ordering.order_runs(j5_run_matrix(spark, sf_dir))


@query(
    "j7_fill_empty_periods",
    f"""
    WITH {SENT}, failed AS (
      SELECT run_id, send_ms // 10000 AS period, count(*) AS messages FROM sent
      WHERE status = 'failed' GROUP BY ALL),
    calendar AS (
      SELECT run_id, unnest(range(0, max(period) + 1)) AS period FROM failed GROUP BY run_id)
    SELECT run_id, period, coalesce(messages, 0) AS messages
    FROM calendar LEFT JOIN failed USING (run_id, period)""",
)
def j7_fill_empty_periods(spark, sf_dir):
    failed = (
        recipes.sends(spark, sf_dir)
        .where("status = 'failed'")
        .groupBy(*RUN, aggregates.period_of(F.col("send_ms")).alias("period"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return joins.fill_empty_periods(stored(failed), RUN, "period", ["messages"], first=long(0))


# --- aggregates --------------------------------------------------------------------

COUNTERS_SQL = (
    RECV
    + """,
sides AS (
  SELECT run_id, worker, send_ms // 10000 AS period, 1 AS s, bytes AS sb, 0 AS r, 0 AS rb
  FROM sent WHERE status = 'ok'
  UNION ALL
  SELECT run_id, worker, CAST(floor(receive_ms / 10000) AS BIGINT), 0, 0, 1, bytes FROM recv),
counters AS (
  SELECT run_id, period, CAST(sum(s) AS BIGINT) AS messages_sent, CAST(sum(sb) AS BIGINT) AS bytes_sent,
         CAST(sum(r) AS BIGINT) AS messages_received, CAST(sum(rb) AS BIGINT) AS bytes_received
  FROM sides GROUP BY run_id, period),
calendar AS (
  SELECT run_id, unnest(range(min(period), max(period) + 1)) AS period FROM counters GROUP BY run_id),
every AS (
  SELECT run_id, period, coalesce(messages_sent, 0) AS messages_sent, coalesce(bytes_sent, 0) AS bytes_sent,
         coalesce(messages_received, 0) AS messages_received, coalesce(bytes_received, 0) AS bytes_received
  FROM calendar LEFT JOIN counters USING (run_id, period)),
reported AS (SELECT * FROM every WHERE period >= 6),
totals AS (
  SELECT *, CAST(sum(messages_sent) OVER w AS BIGINT) AS total_sent,
         CAST(sum(messages_received) OVER w AS BIGINT) AS total_received
  FROM counters WINDOW w AS (PARTITION BY run_id ORDER BY period))"""
)


def _counters(spark, sf_dir, *by: str):
    sent = filters.successful_only(recipes.sends(spark, sf_dir))
    return aggregates.period_counters(sent, recipes.receives(spark, sf_dir), [*RUN, *by])


def _every_period(spark, sf_dir):
    """Counters of all periods from a run's first to its last, idle ones with zeros."""
    return joins.fill_empty_periods(
        stored(_counters(spark, sf_dir)), RUN, "period", aggregates.COUNTERS
    )


def _reported(spark, sf_dir):
    """Counters of all periods after warm-up."""
    return _every_period(spark, sf_dir).where(
        F.col("period") >= aggregates.period_of(F.lit(filters.WARMUP_MS))
    )


@query("a1_period_counters", f"WITH {COUNTERS_SQL} SELECT * FROM counters")
def a1_period_counters(spark, sf_dir):
    return _counters(spark, sf_dir)


@query(
    "a2_period_rates",
    f"""
    WITH {COUNTERS_SQL}
    SELECT run_id, period, round(messages_sent / 10.0::DOUBLE, 6) AS publish_rate,
           round(bytes_sent / 10.0::DOUBLE / 1e6, 9) AS publish_mb_per_s,
           round(messages_received / 10.0::DOUBLE, 6) AS consume_rate,
           round(bytes_received / 10.0::DOUBLE / 1e6, 9) AS consume_mb_per_s
    FROM counters""",
)
def a2_period_rates(spark, sf_dir):
    columns = ["publish_rate", "publish_mb_per_s", "consume_rate", "consume_mb_per_s"]
    rates = aggregates.period_rates(_counters(spark, sf_dir)).select(*RUN, "period", *columns)
    return rounded(rates, *columns, places=9)


@query(
    "a3_running_totals",
    f"WITH {COUNTERS_SQL} SELECT run_id, period, total_sent, total_received FROM totals",
)
def a3_running_totals(spark, sf_dir):
    totals = aggregates.running_totals(stored(_counters(spark, sf_dir)))
    return totals.select(*RUN, "period", "total_sent", "total_received")


@query(
    "a4_backlog",
    f"""
    WITH {COUNTERS_SQL}
    SELECT run_id, period, 3 * total_sent - total_received AS backlog,
           (3 * total_sent - total_received) * 9 AS backlog_bytes FROM totals""",
)
def a4_backlog(spark, sf_dir):
    totals = aggregates.running_totals(stored(_counters(spark, sf_dir)))
    left = aggregates.backlog(totals, F.lit(SUBSCRIPTIONS), F.lit(MESSAGE_SIZE))
    return left.select(*RUN, "period", "backlog", "backlog_bytes")


@query(
    "a5_latency_mean",
    f"""
    WITH {PUBLISHED} SELECT run_id, period, round(avg(latency_us) / 1000, 6) AS latency_avg
    FROM published GROUP BY run_id, period""",
)
def a5_latency_mean(spark, sf_dir):
    published = reports.publish_latencies(recipes.sends(spark, sf_dir))
    means = aggregates.latency_mean(published, [*RUN, "period"], "latency_us")
    return rounded(means, "latency_avg")


def _summary_query(source: str, body: str, keys_sql: str) -> str:
    return (
        f"WITH {source}, ranked AS ({ranked_sql(body, keys_sql)}) "
        f"SELECT {keys_sql}, {summary_sql()} FROM ranked GROUP BY {keys_sql}"
    )


@query("a6_latency_percentiles", _summary_query(DELIVERED, "delivered", "run_id, period"))
def a6_latency_percentiles(spark, sf_dir):
    """End-to-end latency of every period; the mean and maximum come along."""
    groups = [*RUN, "period"]
    buckets = histograms.bucket_counts(
        reports.e2e_latencies(recipes.receives(spark, sf_dir)), groups, "latency_us"
    )
    summary = histograms.latency_summary(buckets, groups).select(*groups, *LATENCY_COLUMNS)
    return rounded(summary, *LATENCY_COLUMNS)


@query(
    "a7_latency_max",
    f"""
    WITH {PUBLISHED} SELECT run_id, period, round(max(bucket) / 1000, 6) AS latency_max
    FROM published GROUP BY run_id, period""",
)
def a7_latency_max(spark, sf_dir):
    groups = [*RUN, "period"]
    published = reports.publish_latencies(recipes.sends(spark, sf_dir))
    top = F.max(latency.hdr_bucket(F.col("latency_us")))
    worst = published.groupBy(*groups).agg(latency.us_to_ms(top).alias("latency_max"))
    return rounded(worst, "latency_max")


@query(
    "a8_merge_histograms",
    f"WITH {PUBLISHED} SELECT run_id, bucket, count(*) AS n FROM published GROUP BY run_id, bucket",
)
def a8_merge_histograms(spark, sf_dir):
    """Histograms of single workers and periods, added up per run."""
    sent = filters.successful_only(recipes.sends(spark, sf_dir))
    kept = filters.drop_warmup(sent, "send_ms").withColumn(
        "period", aggregates.period_of(F.col("send_ms"))
    )
    single = histograms.bucket_counts(kept, [*RUN, "worker", "period"], "latency_us", "bytes")
    return histograms.merge_histograms(single, RUN).select(*RUN, "bucket", "n")


SKETCHED = (0.5, 0.95, 0.99, 0.999)


@query(
    "a8_merge_sketches",
    f"""
    WITH {PUBLISHED}
    SELECT run_id, quantile, count(latency_us) AS messages, true AS close
    FROM published CROSS JOIN (SELECT unnest({list(SKETCHED)})::DOUBLE AS quantile) GROUP BY run_id, quantile""",
)
def a8_merge_sketches(spark, sf_dir):
    """Quantiles of runs from the sketches of single workers and periods, held against the messages' true ranks."""
    sent = filters.drop_warmup(filters.successful_only(recipes.sends(spark, sf_dir)), "send_ms")
    published = sent.withColumn("period", aggregates.period_of(F.col("send_ms")))
    single = stored(sketches.latency_sketches(published, [*RUN, "worker", "period"]))
    merged = sketches.merge_sketches(single, RUN)
    found = sketches.sketch_quantiles(merged, RUN, SKETCHED).withColumnRenamed("latency_us", "estimate")
    ranks = published.select(*RUN, "latency_us").join(found, RUN).groupBy(*RUN, "quantile", "messages").agg(
        F.count_if(F.col("latency_us") < F.col("estimate")).alias("below"),
        F.count_if(F.col("latency_us") <= F.col("estimate")).alias("upto"),
    )
    rank, error = F.col("quantile") * F.col("messages"), F.lit(sketches.RANK_ERROR) * F.col("messages") + 1
    return ranks.select(*RUN, "quantile", "messages", rank.between(F.col("below") - error, F.col("upto") + error).alias("close"))


@query("a9_run_latency", _summary_query(PUBLISHED, "published", "run_id"))
def a9_run_latency(spark, sf_dir):
    published = reports.publish_latencies(recipes.sends(spark, sf_dir))
    summary = aggregates.run_latency(published, RUN, "latency_us")
    return rounded(summary.select(*RUN, *LATENCY_COLUMNS), *LATENCY_COLUMNS)


# Walks the ladder of levels and finds the first bucket that reaches each.
CURVE_SQL = (
    PUBLISHED
    + """,
counted AS (SELECT run_id, bucket, count(*) AS n FROM published GROUP BY run_id, bucket),
summed AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY run_id ORDER BY bucket) AS BIGINT) AS c,
         CAST(sum(n) OVER (PARTITION BY run_id) AS BIGINT) AS total FROM counted),
ladder AS (SELECT k, j FROM range(0, 24) a(k), range(0, 100) b(j)),
reached AS (
  SELECT run_id, k, j, min(c) AS c, any_value(total) AS total FROM summed, ladder
  WHERE 200 * (total - (total - c) * (1 << k)) >= j * total GROUP BY run_id, k, j),
points AS (
  SELECT run_id, c FROM reached
  UNION SELECT run_id, max(c) FROM summed GROUP BY run_id),
curve AS (
  SELECT run_id, 100.0::DOUBLE * c / total AS percentile, bucket / 1000.0::DOUBLE AS value_ms
  FROM points JOIN summed USING (run_id, c))"""
)


def _curve(spark, sf_dir):
    published = reports.publish_latencies(recipes.sends(spark, sf_dir))
    return histograms.quantile_curve(
        histograms.bucket_counts(published, RUN, "latency_us"), RUN
    )


_CURVE_COLUMNS = "run_id, round(percentile, 6) AS percentile, round(value_ms, 6) AS value_ms"


@query("a10_quantile_curve", f"WITH {CURVE_SQL} SELECT {_CURVE_COLUMNS} FROM curve")
def a10_quantile_curve(spark, sf_dir):
    return rounded(_curve(spark, sf_dir), "percentile", "value_ms")


@query(
    "f5_percentile_cutoff",
    f"WITH {CURVE_SQL} SELECT {_CURVE_COLUMNS} FROM curve WHERE percentile <= 99.999",
)
def f5_percentile_cutoff(spark, sf_dir):
    return rounded(filters.percentile_cutoff(_curve(spark, sf_dir)), "percentile", "value_ms")


@query(
    "o2_order_quantiles",
    f"WITH {CURVE_SQL} SELECT {_CURVE_COLUMNS} FROM curve ORDER BY curve.percentile",
)
def o2_order_quantiles(spark, sf_dir):
    as_text = _curve(spark, sf_dir).withColumn("percentile", F.col("percentile").cast("string"))
    ordered = ordering.order_quantiles(as_text)
    numeric = ordered.withColumn("percentile", F.col("percentile").cast("double"))
    return rounded(numeric, "percentile", "value_ms")


@query(
    "a11_mean_rates",
    f"""
    WITH {COUNTERS_SQL}
    SELECT run_id, round(avg(messages_sent / 10.0::DOUBLE), 6) AS publish_rate,
           round(avg(messages_received / 10.0::DOUBLE), 6) AS consume_rate,
           round(avg(messages_sent / 10.0::DOUBLE) * 1024 * 1e-6, 9) AS publish_mb_per_s,
           round(avg(messages_received / 10.0::DOUBLE) * 1024 * 1e-6, 9) AS consume_mb_per_s
    FROM reported GROUP BY run_id""",
)
def a11_mean_rates(spark, sf_dir):
    rates = aggregates.period_rates(_reported(spark, sf_dir))
    means = aggregates.mean_rates(rates, RUN, F.lit(1024))
    means = rounded(means, "publish_rate", "consume_rate")
    return rounded(means, "publish_mb_per_s", "consume_mb_per_s", places=9)


@query(
    "a12_counter_totals",
    f"""
    WITH {RECV}, s AS (
      SELECT run_id, count(*) AS total_sent, count(*) FILTER (WHERE seq < 24) AS probes FROM sent
      WHERE status = 'ok' GROUP BY 1),
    r AS (SELECT run_id, count(*) AS total_received FROM recv GROUP BY 1)
    SELECT run_id, total_sent, probes, total_received FROM s JOIN r USING (run_id)""",
)
def a12_counter_totals(spark, sf_dir):
    """The first message of each producer and run counts as a probe."""
    sent = filters.successful_only(recipes.sends(spark, sf_dir)).withColumn("is_probe", F.col("seq") < 24)
    return aggregates.counter_totals(sent, recipes.receives(spark, sf_dir), RUN)


@query("a13_merge_workers", f"WITH {COUNTERS_SQL} SELECT * FROM counters")
def a13_merge_workers(spark, sf_dir):
    single = _counters(spark, sf_dir, "worker")
    return aggregates.merge_workers(single, [*RUN, "period"])


@query(
    "o4_union_workers",
    f"""
    WITH {COUNTERS_SQL}, single AS (
      SELECT run_id, worker, period, sum(s) AS n FROM sides GROUP BY ALL)
    SELECT run_id, count(*) AS worker_periods, CAST(sum(n) AS BIGINT) AS messages_sent
    FROM single GROUP BY run_id""",
)
def o4_union_workers(spark, sf_dir):
    """Statistics of the senders and of the receivers, put together before they are summed."""
    sent = filters.successful_only(recipes.sends(spark, sf_dir))
    received = recipes.receives(spark, sf_dir)
    parts = [
        rows.groupBy(*RUN, "worker", aggregates.period_of(F.col(at)).alias("period")).agg(
            F.count(F.lit(1)).alias(f"messages_{side}")
        )
        for rows, at, side in ((sent, "send_ms", "sent"), (received, "receive_ms", "received"))
    ]
    merged = aggregates.union_workers(*parts).groupBy(*RUN, "worker", "period").agg(
        F.sum("messages_sent").alias("messages_sent")
    )
    return merged.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("worker_periods"), F.sum("messages_sent").alias("messages_sent")
    )


@query("a14_key_frequency", f"WITH {SENT} SELECT key, count(*) AS n FROM sent GROUP BY key")
def a14_key_frequency(spark, sf_dir):
    return aggregates.key_frequency(recipes.sends(spark, sf_dir))


@query(
    "a14_distinct_keys",
    f"""
    WITH {SENT}
    SELECT count(*) AS draws, count(DISTINCT (producer_seq + 1) % 10000) AS distinct_keys FROM sent""",
)
def a14_distinct_keys(spark, sf_dir):
    drawn = _keyed(spark, sf_dir, "KEY_ROUND_ROBIN")
    counted = aggregates.distinct_keys(drawn)
    return counted


@query(
    "a15_last_offsets",
    f"""
    WITH {SENT}
    SELECT topic, "partition", max(seq) AS seq, arg_max(producer_id, seq) AS producer_id
    FROM sent GROUP BY topic, "partition" """,
)
def a15_last_offsets(spark, sf_dir):
    return aggregates.last_offsets(recipes.sends(spark, sf_dir), "seq", "producer_id")


@query(
    "a16_axis_max",
    f"""
    WITH {COUNTERS_SQL}, points AS (
      SELECT run_id, 'publish' AS metric, messages_sent / 10.0::DOUBLE AS y FROM reported
      UNION ALL SELECT run_id, 'consume', messages_received / 10.0::DOUBLE FROM reported)
    SELECT run_id, metric, round(max(y) * 1.2::DOUBLE, 6) AS axis_max FROM points GROUP BY ALL""",
)
def a16_axis_max(spark, sf_dir):
    rates = aggregates.period_rates(_reported(spark, sf_dir))
    points = rates.select(
        *RUN,
        F.inline(
            F.array(
                F.struct(F.lit("publish").alias("metric"), F.col("publish_rate").alias("y")),
                F.struct(F.lit("consume").alias("metric"), F.col("consume_rate").alias("y")),
            )
        ),
    )
    return rounded(aggregates.axis_max(points, [*RUN, "metric"]), "axis_max")


@query(
    "a17_collect_series",
    f"""
    WITH {COUNTERS_SQL}
    , summed AS (
      SELECT *, sum(messages_sent) OVER w AS total_sent, sum(messages_received) OVER w AS total_received,
             row_number() OVER w - 1 AS i
      FROM every WINDOW w AS (PARTITION BY run_id ORDER BY period))
    SELECT run_id, i // 100 AS part, count(*) AS points,
           string_agg(CAST(messages_sent AS VARCHAR), ',' ORDER BY period) AS sent,
           string_agg(CAST(CAST(3 * total_sent - total_received AS BIGINT) AS VARCHAR), ',' ORDER BY period) AS backlog
    FROM summed GROUP BY run_id, i // 100""",
)
def a17_collect_series(spark, sf_dir):
    """Arrays of at most 100 periods, shown as text."""
    totals = aggregates.running_totals(stored(_every_period(spark, sf_dir)))
    left = aggregates.backlog(totals, F.lit(SUBSCRIPTIONS), F.lit(MESSAGE_SIZE))
    columns = {"sent": "messages_sent", "backlog": "backlog"}
    series = reports.collect_series(left, columns, periods_per_document=100)
    return series.select(
        *RUN, "part", long(F.size("sent")).alias("points"),
        *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in columns],
    )


@query(
    "a18_op_stats",
    f"""
    WITH {SENT}, ops AS (
      SELECT topic AS op, status = 'ok' AS success, latency_us, {bucket_sql("latency_us")} AS bucket
      FROM sent),
    ranked AS ({ranked_sql("ops", "op, success")})
    SELECT op, success, count(*) AS events, round(sum(latency_us) / 1000, 3) AS total_ms, {summary_sql()}
    FROM ranked GROUP BY op, success""",
)
def a18_op_stats(spark, sf_dir):
    ops = recipes.sends(spark, sf_dir).select(
        F.col("topic").alias("op"), (F.col("status") == "ok").alias("success"), "latency_us"
    )
    stats = aggregates.op_stats(ops, ["op"], "latency_us")
    return rounded(rounded(stats, *LATENCY_COLUMNS), "total_ms", places=3)


@query(
    "a20_send_summary",
    f"""
    WITH {SENT}
    SELECT run_id, count(*) FILTER (WHERE status = 'failed') AS failed,
           count(*) FILTER (WHERE status = 'ok') AS succeeded
    FROM sent GROUP BY run_id""",
)
def a20_send_summary(spark, sf_dir):
    return aggregates.send_summary(recipes.sends(spark, sf_dir), RUN)


@query(
    "period_stats",
    f"""
    WITH {PUBLISHED}, ranked AS ({ranked_sql("published", "run_id, period")})
    SELECT run_id, period, count(*) AS messages, round(count(*) / 10.0::DOUBLE, 6) AS publish_rate,
           round(avg(latency_us) / 1000, 6) AS latency_avg,
           round(min(bucket) FILTER (WHERE rn * 10000 >= 5000 * total) / 1000, 6) AS latency_50pct,
           round(min(bucket) FILTER (WHERE rn * 10000 >= 9900 * total) / 1000, 6) AS latency_99pct,
           round(max(bucket) / 1000, 6) AS latency_max
    FROM ranked GROUP BY run_id, period""",
)
def period_stats(spark, sf_dir):
    """The flagship: publish rate and latency of each 10 s period after warm-up."""
    stats = reports.flagship(recipes.sends(spark, sf_dir))
    return rounded(
        stats, "publish_rate", "latency_avg", "latency_50pct", "latency_99pct", "latency_max"
    )


def _canonical_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The log in its canonical form, with epoch times, written to files and read back."""
    folder = shared_folder(spark, "canonical")
    epoch_us = F.lit(recipes.EPOCH_MS * 1000)
    send_us = epoch_us + F.col("send_ms") * F.lit(1000)
    sent = recipes.sends(spark, sf_dir).withColumns(
        {"send_us": send_us, "ack_us": send_us + F.col("latency_us"), "payload": F.col("payload").cast("binary")}
    )
    received = recipes.receives(spark, sf_dir).select(
        "*", F.col("bytes").alias("payload_len"), long(0).alias("consumer_id")
    ).withColumns({c: F.col(c) + F.lit(recipes.EPOCH_MS) for c in ("publish_ms", "receive_ms")})
    for name, rows, schema in (("sent", sent, MESSAGES_SENT), ("received", received, MESSAGES_RECEIVED)):
        rows.select(*schema.fieldNames()).write.parquet(f"{folder}/{name}")
    return (
        message_log.read_message_log(spark, f"{folder}/sent", MESSAGES_SENT),
        message_log.read_message_log(spark, f"{folder}/received", MESSAGES_RECEIVED),
    )


@query(
    "period_stats_canonical",
    f"""
    WITH {RECV}, starts AS (SELECT run_id, min(send_ms) AS start_ms FROM sent GROUP BY run_id),
    published AS (
      SELECT run_id, (send_ms - start_ms) // 10000 AS period, latency_us, {bucket_sql("latency_us")} AS bucket
      FROM sent JOIN starts USING (run_id) WHERE status = 'ok' AND send_ms - start_ms >= 60000),
    ranked AS ({ranked_sql("published", "run_id, period")}),
    arrived AS (
      SELECT run_id, CAST(floor((receive_ms - start_ms) / 10000) AS BIGINT) AS period, count(*) AS received
      FROM recv JOIN starts USING (run_id) GROUP BY ALL),
    stats AS (
      SELECT run_id, period, count(*) AS messages, round(count(*) / 10.0::DOUBLE, 6) AS publish_rate,
             round(avg(latency_us) / 1000, 6) AS latency_avg,
             round(min(bucket) FILTER (WHERE rn * 10000 >= 9900 * total) / 1000, 6) AS latency_99pct
      FROM ranked GROUP BY run_id, period)
    SELECT stats.*, coalesce(received, 0) AS messages_received
    FROM stats LEFT JOIN arrived USING (run_id, period)""",
)
def period_stats_canonical(spark, sf_dir):
    """Rates and latency of each period from a canonical log: runs start when they first send."""
    sent, received = _canonical_log(spark, sf_dir)
    starts = message_log.run_starts(sent)
    stats = reports.flagship(message_log.relative_sends(sent, starts)).select(
        *RUN, "period", "messages", "publish_rate", "latency_avg", "latency_99pct"
    )
    arrived = message_log.relative_receives(received, starts).groupBy(
        *RUN, aggregates.period_of(F.col("receive_ms")).alias("period")
    ).agg(F.count(F.lit(1)).alias("received"))
    both = stats.join(arrived, [*RUN, "period"], "left").withColumn(
        "messages_received", F.coalesce("received", long(0))
    )
    return rounded(both.drop("received"), "publish_rate", "latency_avg", "latency_99pct")


# The statistics of a report line, as shown -> column.
PERIOD_SHOWN = {
    "avg": "latency_avg", "50%": "latency_50pct", "99%": "latency_99pct", "99.9%": "latency_999pct",
    "Max": "latency_max",
}
RUN_SHOWN = {
    "avg": "latency_avg", "50%": "latency_50pct", "95%": "latency_95pct", "99%": "latency_99pct",
    "99.9%": "latency_999pct", "99.99%": "latency_9999pct", "Max": "latency_max",
}


def _latency_sql(table: str, shown: dict[str, str]) -> str:
    parts = [f"'{n}: ' || printf('%4s', printf('%.1f', coalesce({table}.{c}, 0)))" for n, c in shown.items()]
    return " || ' - ' || ".join(parts)


def _rates_sql(width: int, p: str, p_mb: str, c: str, c_mb: str) -> str:
    return f"""'Pub rate ' || printf('%{width}s', printf('%.1f', {p})) || ' msg/s / '
      || printf('%4s', printf('%.1f', {p_mb})) || ' MB/s | Cons rate '
      || printf('%{width}s', printf('%.1f', {c})) || ' msg/s / '
      || printf('%4s', printf('%.1f', {c_mb})) || ' MB/s'"""


_BOTH_STATS = f"""
    {PUBLISHED_ONLY}, {DELIVERED_ONLY}"""


def _stats_sql(keys: str) -> str:
    return f"""
    p AS (SELECT {keys}, {summary_sql()} FROM ({ranked_sql("published", keys)}) GROUP BY {keys}),
    e AS (SELECT {keys}, {summary_sql()} FROM ({ranked_sql("delivered", keys)}) GROUP BY {keys})"""


@query(
    "p16_report_line",
    f"""
    WITH {COUNTERS_SQL}, {_BOTH_STATS}, {_stats_sql("run_id, period")},
    summed AS (
      SELECT *, CAST(3 * sum(messages_sent) OVER w - sum(messages_received) OVER w AS BIGINT) AS backlog
      FROM every WINDOW w AS (PARTITION BY run_id ORDER BY period))
    SELECT run_id, period, {_rates_sql(7, "messages_sent / 10.0::DOUBLE", "bytes_sent / 10.0::DOUBLE / 1e6", "messages_received / 10.0::DOUBLE", "bytes_received / 10.0::DOUBLE / 1e6")}
        || ' | Backlog: ' || CAST(backlog AS VARCHAR) || ' msg | Pub Latency (ms) '
        || {_latency_sql("p", PERIOD_SHOWN)} AS line,
      'E2E Latency (ms) ' || {_latency_sql("e", PERIOD_SHOWN)} AS e2e_line
    FROM summed LEFT JOIN p USING (run_id, period) LEFT JOIN e USING (run_id, period) WHERE period >= 6""",
)
def p16_report_line(spark, sf_dir):
    """Both progress lines of each period after warm-up."""
    messages = reports.period_histograms(recipes.sends(spark, sf_dir), recipes.receives(spark, sf_dir))
    report = reports.period_report(stored(messages), F.lit(SUBSCRIPTIONS), F.lit(1024))

    def shown(side: str) -> dict[str, Column]:
        return {name: F.col(f"{side}_{column}") for name, column in PERIOD_SHOWN.items()}

    line = text.period_line(
        F.col("publish_rate"), F.col("publish_mb_per_s"), F.col("consume_rate"), F.col("consume_mb_per_s"),
        F.col("backlog"), shown("publish"),
    )
    return report.select(
        *RUN, "period", line.alias("line"), text.latency_line("E2E Latency", shown("endToEnd")).alias("e2e_line")
    )


@query(
    "p16_summary_lines",
    f"""
    WITH {COUNTERS_SQL}, {_BOTH_STATS}, {_stats_sql("run_id")}, means AS (
      SELECT run_id, avg(messages_sent / 10.0::DOUBLE) AS p, avg(messages_received / 10.0::DOUBLE) AS c
      FROM reported GROUP BY run_id)
    SELECT run_id, '----- Aggregated ' || {_rates_sql(4, "means.p", "means.p * 1024 * 1e-6", "means.c", "means.c * 1024 * 1e-6")} AS rates,
      '----- Aggregated Pub Latency (ms) ' || {_latency_sql("p", RUN_SHOWN)} AS latency,
      '----- Aggregated E2E Latency (ms) ' || {_latency_sql("e", RUN_SHOWN)} AS e2e_latency
    FROM means JOIN p USING (run_id) JOIN e USING (run_id)""",
)
def p16_summary_lines(spark, sf_dir):
    """The three closing lines of a run."""
    means = aggregates.mean_rates(aggregates.period_rates(_reported(spark, sf_dir)), RUN, F.lit(1024))
    sides = {
        "publish": reports.publish_latencies(recipes.sends(spark, sf_dir)),
        "e2e": reports.e2e_latencies(recipes.receives(spark, sf_dir)),
    }
    lines = means.select(
        *RUN,
        text.summary_line(
            F.col("publish_rate"), F.col("publish_mb_per_s"),
            F.col("consume_rate"), F.col("consume_mb_per_s"),
        ).alias("rates"),
    )
    for title, name, side in (("Pub", "latency", "publish"), ("E2E", "e2e_latency", "e2e")):
        shown = {n: F.col(column) for n, column in RUN_SHOWN.items()}
        line = text.latency_line(f"----- Aggregated {title} Latency", shown).alias(name)
        lines = lines.join(aggregates.run_latency(sides[side], RUN, "latency_us").select(*RUN, line), RUN)
    return lines


# --- windows -------------------------------------------------------------------------

CONTROL_SQL = (
    HELD
    + """,
control AS (
  SELECT run_id, w AS at_min, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(r) AS BIGINT) AS received FROM (
    SELECT run_id, send_ms // 60000 AS w, 1 AS s, 0 AS r FROM sent WHERE status = 'ok'
    UNION ALL SELECT run_id, CAST(floor(receive_ms / 60000) AS BIGINT), 0, 1 FROM held) GROUP BY ALL),
progress AS (
  SELECT run_id, (at_min + 1) * 60000 AS at_ms,
         CAST(sum(sent) OVER w AS BIGINT) AS total_sent, CAST(sum(received) OVER w AS BIGINT) AS total_received
  FROM control WINDOW w AS (PARTITION BY run_id ORDER BY at_min)),
rates AS (
  SELECT run_id, at_ms,
    (total_sent - lag(total_sent) OVER w) / ((at_ms - lag(at_ms) OVER w) / 1000.0::DOUBLE) AS publish_rate,
    (total_received - lag(total_received) OVER w) / ((at_ms - lag(at_ms) OVER w) / 1000.0::DOUBLE) AS receive_rate
  FROM progress WINDOW w AS (PARTITION BY run_id ORDER BY at_ms)
  QUALIFY lag(at_ms) OVER w IS NOT NULL)"""
)


def _progress(spark, sf_dir, tick_ms: int = CONTROL_MS):
    """Totals at the end of each control period, while consumers pause now and then."""
    sent = filters.successful_only(recipes.sends(spark, sf_dir))
    counters = aggregates.period_counters(
        sent, recipes.held_receives(spark, sf_dir), RUN, period_ms=tick_ms
    )
    totals = aggregates.running_totals(stored(counters))
    return totals.withColumn("at_ms", (F.col("period") + 1) * F.lit(tick_ms))


def _control(spark, sf_dir):
    totals = stored(
        _progress(spark, sf_dir).select(*RUN, "at_ms", "total_sent", "total_received")
    )
    rates = windows.counter_delta(totals, RUN, "at_ms", ["total_sent", "total_received"])
    return rates.select(
        *RUN, "at_ms",
        F.col("total_sent_rate").alias("publish_rate"),
        F.col("total_received_rate").alias("receive_rate"),
    )


@query(
    "w1_counter_delta",
    f"""
    WITH {CONTROL_SQL}
    SELECT run_id, at_ms, round(publish_rate, 6) AS publish_rate, round(receive_rate, 6) AS receive_rate
    FROM rates""",
)
def w1_counter_delta(spark, sf_dir):
    return rounded(_control(spark, sf_dir), "publish_rate", "receive_rate")


@query(
    "w2_sustain_verdict",
    f"""
    WITH {CONTROL_SQL}, targets AS (
      SELECT *, 1000 / 360.0::DOUBLE / 3 * CAST([0.5, 1.0, 2.0][CAST(run_id AS INTEGER) + 1] AS DOUBLE) AS target
      FROM rates)
    SELECT run_id, at_ms, CASE WHEN publish_rate < target * 0.95::DOUBLE THEN 'producer-bound'
      WHEN receive_rate < publish_rate * 0.98::DOUBLE THEN 'consumer-bound' ELSE 'ok' END AS verdict
    FROM targets""",
)
def w2_sustain_verdict(spark, sf_dir):
    factors = F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))
    factor = F.element_at(factors, (F.col("run_id") + 1).cast("int"))
    target = F.lit(1000 / 360.0 / 3) * factor
    verdict = windows.sustain_verdict(F.col("publish_rate"), F.col("receive_rate"), target)
    return _control(spark, sf_dir).select(*RUN, "at_ms", verdict.alias("verdict"))


@query(
    "w4_backlog_phases",
    f"""
    WITH {HELD}, ticks AS (
      SELECT run_id, w, sum(s) AS s, sum(r) AS r FROM (
        SELECT run_id, send_ms // 1000 AS w, 1 AS s, 0 AS r FROM sent WHERE status = 'ok'
        UNION ALL SELECT run_id, CAST(floor(receive_ms / 1000) AS BIGINT), 0, 1 FROM held) GROUP BY ALL),
    left_over AS (
      SELECT run_id, (w + 1) * 1000 AS at_ms,
             3 * sum(s) OVER (PARTITION BY run_id ORDER BY w) - sum(r) OVER (PARTITION BY run_id ORDER BY w) AS b
      FROM ticks),
    built AS (SELECT run_id, min(at_ms) AS built_ms FROM left_over WHERE b * 9 >= 4000 GROUP BY run_id)
    SELECT run_id, built_ms, min(at_ms) AS drained_ms
    FROM built LEFT JOIN left_over USING (run_id)
    WHERE at_ms > built_ms AND b <= 150 GROUP BY run_id, built_ms""",
)
def w4_backlog_phases(spark, sf_dir):
    ticks = stored(_progress(spark, sf_dir, 1000))
    left = aggregates.backlog(ticks, F.lit(SUBSCRIPTIONS), F.lit(MESSAGE_SIZE))
    return windows.backlog_phases(
        left, RUN, "at_ms", requested_bytes=F.lit(4000), drained_messages=150
    )


@query(
    "w5_sample_seconds",
    f"""
    WITH {COUNTERS_SQL}, placed AS (
      SELECT run_id, messages_sent, row_number() OVER (PARTITION BY run_id ORDER BY period) - 1 AS i
      FROM every)
    SELECT run_id, 10 * i AS x, messages_sent AS y FROM placed""",
)
def w5_sample_seconds(spark, sf_dir):
    series = reports.collect_series(_every_period(spark, sf_dir), {"sent": "messages_sent"})
    points = series.select(*RUN, "part", F.posexplode("sent").alias("pos", "y"))
    position = F.col("part") * F.lit(reports.PERIODS_PER_DOCUMENT) + F.col("pos")
    return points.select(*RUN, windows.sample_seconds(position).alias("x"), "y")


@query(
    "w6_ready_at",
    f"""
    WITH {HELD}, ticks AS (
      SELECT run_id, CAST(floor(receive_ms / 1000) AS BIGINT) AS w, count(*) AS r FROM held GROUP BY ALL),
    totals AS (SELECT run_id, (w + 1) * 1000 AS at_ms,
      sum(r) OVER (PARTITION BY run_id ORDER BY w) AS t FROM ticks)
    SELECT run_id, min(at_ms) FILTER (WHERE t >= 15) AS ready_ms FROM totals GROUP BY run_id""",
)
def w6_ready_at(spark, sf_dir):
    """Five topics with three subscriptions each."""
    return windows.ready_at(_progress(spark, sf_dir, 1000), RUN, "at_ms", F.lit(15))


@query(
    "w7_monotonic_ids",
    f"""
    WITH {SENT}
    SELECT producer_id, producer_seq, greatest(5000, max(ack_ms - latency_us // 7) OVER (
             PARTITION BY producer_id ORDER BY producer_seq)) AS tx_id
    FROM sent""",
)
def w7_monotonic_ids(spark, sf_dir):
    """Clocks that step back now and then, continuing after id 5000."""
    clock = F.col("ack_ms") - latency.whole_div(F.col("latency_us"), 7)
    writes = recipes.sends(spark, sf_dir).select("producer_id", "producer_seq", clock.alias("clock"))
    ids = windows.monotonic_ids(writes, ["producer_id"], "producer_seq", "clock", long(5000))
    return ids.drop("clock")


# --- orders and limits, repeats --------------------------------------------------------


@query(
    "o3_take_n",
    f"""
    WITH {SENT}, drawn AS (
      SELECT seq, {token_sql("keys", "((producer_seq + 1) % 10000)", 7)} AS key FROM sent)
    SELECT seq, key FROM drawn ORDER BY seq LIMIT 1000""",
)
def o3_take_n(spark, sf_dir):
    drawn = recipes.sends(spark, sf_dir).select(
        "seq", keys.key_round_robin(F.col("producer_id"), F.col("producer_seq")).alias("key")
    )
    return ordering.take_n(drawn, 1000, "seq")


@query(
    "t7_dedup_batch",
    f"WITH {SENT} SELECT producer_id, count(*) AS messages FROM sent GROUP BY producer_id",
)
def t7_dedup_batch(spark, sf_dir):
    sent = recipes.sends(spark, sf_dir).select("producer_id", "producer_seq", "seq")
    repeated = sent.unionByName(sent.where(F.col("seq") % 20 == 0))
    kept = pairing.drop_repeats(repeated)
    return kept.groupBy("producer_id").agg(F.count(F.lit(1)).alias("messages"))
