"""Registered scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import config, latency, naming, payload, text
from tidewire.plans import recipes
from tidewire.plans.catalog.registry import (
    RECV, SENT, bucket_sql, query, rounded, system_sql, token_sql,
)
from tidewire.plans.recipes import long, table


def _eid():
    return F.col("event_id")


# Prefixes that two systems take from their configuration.
CONFIGURED = {"pulsar": "persistent://benchmark/ns/test", "stamped-stream": "bench-stream"}


@query(
    "p1_topic_name",
    f"""
    WITH named AS (SELECT event_id, {system_sql("event_id")} AS system FROM events)
    SELECT event_id, printf('%s-%s-%04d', CASE system
        WHEN 'kafka' THEN 'test-topic' WHEN 'rabbitmq' THEN 'test-topic'
        WHEN 'rocketmq' THEN 'RocketMQ-Benchmark' WHEN 'artemis' THEN 'test'
        WHEN 'nats' THEN 'Nats-benchmark' WHEN 'nats-streaming' THEN 'Nats-streaming-benchmark'
        WHEN 'nsq' THEN 'Nsq-Benchmark' WHEN 'distributedlog' THEN 'test-stream'
        WHEN 'pulsar' THEN 'persistent://benchmark/ns/test' ELSE 'bench-stream' END,
      {token_sql("topic", "event_id", 5)}, event_id % 20000) AS topic
    FROM named""",
)
def p1_topic_name(spark, sf_dir):
    system = recipes.system_of(_eid())
    configured = F.when(system == "pulsar", CONFIGURED["pulsar"]).when(
        system == "stamped-stream", CONFIGURED["stamped-stream"]
    )
    prefix = naming.topic_prefix(system, configured)
    token = naming.random_token("topic", _eid())
    return table(spark, sf_dir, "events").select(
        "event_id", naming.topic_name(prefix, token, _eid() % 20000).alias("topic")
    )


@query(
    "p2_subscription_name",
    f"""
    SELECT event_id, printf('sub-%03d-%s', event_id % 1500, {token_sql("sub", "event_id", 5)})
      AS subscription
    FROM events""",
)
def p2_subscription_name(spark, sf_dir):
    name = naming.subscription_name(_eid() % 1500, naming.random_token("sub", _eid()))
    return table(spark, sf_dir, "events").select("event_id", name.alias("subscription"))


@query(
    "p3_substream_queue_name",
    """
    SELECT event_id, printf('%s/%06d', event_type, event_id % 64) AS substream,
           event_type || '-' || CAST(user_id AS VARCHAR) AS queue
    FROM events""",
)
def p3_substream_queue_name(spark, sf_dir):
    topic = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        naming.substream_name(topic, _eid() % 64).alias("substream"),
        naming.queue_name(topic, F.col("user_id").cast("string")).alias("queue"),
    )


@query(
    "p4_clean_name",
    "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9-]', '', 'g') AS name FROM pages",
)
def p4_clean_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", naming.clean_name(F.col("url")).alias("name")
    )


@query(
    "p5_random_token",
    f"""
    SELECT event_id, {token_sql("t", "event_id", 5)} AS token,
           {token_sql("t", "event_id", 7)} AS key_token
    FROM events""",
)
def p5_random_token(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        naming.random_token("t", _eid()).alias("token"),
        naming.random_token("t", _eid(), naming.KEY_BYTES).alias("key_token"),
    )


@query(
    "p6_publish_latency_us",
    """
    WITH timed AS (
      SELECT event_id, CAST(round(value * 1000000) AS BIGINT)
        + CASE WHEN event_id % 50 = 0 THEN -1000000000
               WHEN event_id % 37 = 0 THEN 61000000000 ELSE 0 END AS ns
      FROM events)
    SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL
      ELSE least(greatest(CAST(floor(ns / 1000) AS BIGINT), 0), 60000000) END AS latency_us
    FROM timed""",
)
def p6_publish_latency_us(spark, sf_dir):
    send_ns = _eid() * F.lit(recipes.SPACING_MS * 1_000_000)
    drift = (
        F.when(_eid() % 50 == 0, long(-1_000_000_000))
        .when(_eid() % 37 == 0, long(61_000_000_000))
        .otherwise(long(0))
    )
    ack_ns = F.when(_eid() % 23 != 0, send_ns + long(F.round(F.col("value") * 1_000_000)) + drift)
    return table(spark, sf_dir, "events").select(
        "event_id", latency.publish_latency_us(send_ns, ack_ns).alias("latency_us")
    )


@query(
    "p7_e2e_latency_us",
    f"""
    WITH {RECV}
    SELECT seq, subscription,
           least(greatest((receive_ms - publish_ms) * 1000, 0), 43200000000) AS latency_us
    FROM recv""",
)
def p7_e2e_latency_us(spark, sf_dir):
    us = latency.e2e_latency_us(F.col("publish_ms"), F.col("receive_ms"))
    return recipes.receives(spark, sf_dir).select("seq", "subscription", us.alias("latency_us"))


@query(
    "p8_us_to_ms",
    f"WITH {SENT} SELECT seq, round(latency_us / 1000.0::DOUBLE, 6) AS latency_ms FROM sent",
)
def p8_us_to_ms(spark, sf_dir):
    ms = latency.us_to_ms(F.col("latency_us")).alias("latency_ms")
    return rounded(recipes.sends(spark, sf_dir).select("seq", ms), "latency_ms")


@query(
    "p9_to_mb_per_s",
    "SELECT doc_id, round(n_chars / 10.0::DOUBLE / 1e6, 9) AS mb_per_s FROM documents",
)
def p9_to_mb_per_s(spark, sf_dir):
    rate = latency.to_mb_per_s(F.col("n_chars"), 10.0).alias("mb_per_s")
    return rounded(table(spark, sf_dir, "documents").select("doc_id", rate), "mb_per_s", places=9)


@query(
    "p10_hdr_bucket",
    f"""
    WITH {SENT}, spread AS (
      SELECT seq, latency_us * [1, 7, 1000, 100000, 1000000][CAST(seq % 5 AS INTEGER) + 1] AS us
      FROM sent)
    SELECT seq, us, {bucket_sql("us")} AS bucket FROM spread""",
)
def p10_hdr_bucket(spark, sf_dir):
    factors = F.array(*[long(f) for f in (1, 7, 1000, 100_000, 1_000_000)])
    factor = F.element_at(factors, (F.col("seq") % 5 + 1).cast("int"))
    spread = recipes.sends(spark, sf_dir).select("seq", (F.col("latency_us") * factor).alias("us"))
    return spread.withColumn("bucket", latency.hdr_bucket(F.col("us")))


@query(
    "p11_stamp_payload",
    f"""
    WITH {SENT}
    SELECT seq, upper(printf('%016x', 1704067200000 + send_ms) || hex(encode(payload))) AS stamped,
           1704067200000 + send_ms AS publish_ms, payload
    FROM sent""",
)
def p11_stamp_payload(spark, sf_dir):
    at = F.col("send_ms") + F.lit(recipes.EPOCH_MS)
    stamped = recipes.sends(spark, sf_dir).select(
        "seq", payload.stamp_payload(F.col("payload"), at).alias("message")
    )
    return stamped.select(
        "seq",
        F.hex("message").alias("stamped"),
        payload.stamped_time(F.col("message")).alias("publish_ms"),
        payload.unstamped_payload(F.col("message")).cast("string").alias("payload"),
    )


@query(
    "p12_set_json_field",
    f"""
    WITH {SENT}
    SELECT seq, CASE WHEN seq % 17 = 0 THEN '' WHEN seq % 13 = 0 THEN substr(payload, 2)
      ELSE json_merge_patch(payload, json_object('Timestamp', 1704067200000 + send_ms))::VARCHAR
      END AS payload
    FROM sent""",
)
def p12_set_json_field(spark, sf_dir):
    broken = (
        F.when(F.col("seq") % 17 == 0, F.lit(""))
        .when(F.col("seq") % 13 == 0, F.expr("substring(payload, 2)"))
        .otherwise(F.col("payload"))
    )
    sent = recipes.sends(spark, sf_dir).withColumn("payload", broken)
    at = F.col("send_ms") + F.lit(recipes.EPOCH_MS)
    return sent.select(
        "seq", payload.set_json_field(F.col("payload"), "Timestamp", at).alias("payload")
    )


@query(
    "p13_normalize_publish_ts",
    f"""
    WITH {SENT}, carried AS (
      SELECT seq, {system_sql("seq")} AS system, 1704067200000 + send_ms AS ms FROM sent)
    SELECT seq, CASE WHEN seq % 31 = 0 THEN NULL WHEN system = 'rabbitmq' THEN ms // 1000 * 1000
      ELSE ms END AS publish_ms
    FROM carried""",
)
def p13_normalize_publish_ts(spark, sf_dir):
    system = recipes.system_of(F.col("seq"))
    known = F.when(F.col("seq") % 31 != 0, F.col("send_ms") + F.lit(recipes.EPOCH_MS))
    clock = (
        F.when(system == "rabbitmq", latency.whole_div(known, 1000))
        .when(system == "nats-streaming", known * F.lit(1_000_000))
        .otherwise(known)
    )
    stamped = F.when(known.isNotNull(), payload.stamp_payload(F.col("payload"), known))
    at = payload.normalize_publish_ts(system, clock, known.cast("string"), stamped)
    return recipes.sends(spark, sf_dir).select("seq", at.alias("publish_ms"))


@query(
    "p14_routing_key",
    f"""
    WITH {SENT}, keyed AS (
      SELECT seq, {system_sql("seq")} AS system, CASE WHEN seq % 3 <> 0 THEN key END AS key FROM sent)
    SELECT seq, CASE WHEN system = 'rabbitmq' THEN coalesce(key, '') ELSE key END AS routing_key
    FROM keyed""",
)
def p14_routing_key(spark, sf_dir):
    key = F.when(F.col("seq") % 3 != 0, F.col("key"))
    routed = payload.routing_key(recipes.system_of(F.col("seq")), key)
    return recipes.sends(spark, sf_dir).select("seq", routed.alias("routing_key"))


@query(
    "p15_pad_number",
    """
    SELECT event_id, printf('%7s', printf('%.1f', value)) AS rate,
           printf('%7s', printf('%.1f', -value / 8)) AS small
    FROM events""",
)
def p15_pad_number(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.pad_number(value, text.RATE_WIDTH).alias("rate"),
        text.pad_number(-value / 8, text.RATE_WIDTH).alias("small"),
    )


@query(
    "p17_run_name",
    """
    SELECT o_orderkey, printf('%s-%s-%s', o_orderpriority, o_orderstatus,
             strftime(o_orderdate + to_seconds(o_orderkey), '%Y-%m-%d-%H-%M-%S')) AS run_name,
           'p.' || o_orderstatus || CAST(o_orderkey AS VARCHAR) AS stem
    FROM orders""",
)
def p17_run_name(spark, sf_dir):
    started = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey"))
    number = F.concat(F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    path = F.concat(F.lit("workloads/v1.2/p."), number, F.lit(".yaml"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        naming.run_name(F.col("o_orderpriority"), F.col("o_orderstatus"), started).alias("run_name"),
        naming.workload_stem(path).alias("stem"),
    )


@query("p17_chart_label", "SELECT page_id, replace(url, '/', '-') AS label FROM pages")
def p17_chart_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", naming.chart_label(F.col("url")).alias("label")
    )


@query(
    "p18_percentile_axis",
    """
    WITH pct AS (SELECT event_id, (event_id % 100000) / 1000.0::DOUBLE AS p FROM events)
    SELECT event_id, round(log10(100.0::DOUBLE / (100.0::DOUBLE - p)), 9) AS axis, round(p, 6) AS label
    FROM pct""",
)
def p18_percentile_axis(spark, sf_dir):
    percentile = (_eid() % 100_000) / F.lit(1000.0)
    placed = table(spark, sf_dir, "events").select(
        "event_id", latency.percentile_axis(percentile).alias("axis")
    )
    labelled = placed.withColumn("label", latency.percentile_label(F.col("axis")))
    return rounded(rounded(labelled, "label"), "axis", places=9)


def _rate_sql() -> str:
    rate = "[50000, 0, 10000, -1, 2147483647][CAST(p_partkey % 5 AS INTEGER) + 1]"
    return f"""
    WITH target AS (
      SELECT p_partkey, CASE {rate} WHEN -1 THEN 'Infinity'::DOUBLE
        WHEN 2147483647 THEN 'Infinity'::DOUBLE WHEN 0 THEN 10000.0::DOUBLE
        ELSE CAST({rate} AS DOUBLE) END AS t FROM part)
    SELECT p_partkey AS workload_id, isinf(t) AS unlimited,
           CASE WHEN NOT isinf(t) THEN round(t / 7, 6) END AS per_worker,
           CASE WHEN NOT isinf(t) THEN round(greatest(t / 20000, 1.0::DOUBLE), 6) END AS adjusted
    FROM target"""


@query("p19_resolve_target_rate", _rate_sql())
def p19_resolve_target_rate(spark, sf_dir):
    target = config.resolve_target_rate(F.col("producer_rate"))
    rates = recipes.workloads(spark, sf_dir).select("workload_id", target.alias("target"))
    limited = F.col("target") < F.lit(float("inf"))
    return rounded(
        rates.select(
            "workload_id",
            (~limited).alias("unlimited"),
            F.when(limited, config.rate_per_worker(F.col("target"), F.lit(7))).alias("per_worker"),
            F.when(limited, config.adjusted_rate(F.col("target") / 20_000)).alias("adjusted"),
        ),
        "per_worker",
        "adjusted",
    )


def _properties_text():
    """Common and specific properties text of each order, as found in driver files."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    common = F.concat(
        F.lit("# defaults\nacks=1\nlinger.ms="), (key % 7).cast("string"),
        F.lit("\n\nbatch.size = "), cust, F.lit("\nacks=2"),
    )
    specific = F.concat(
        F.when(key % 3 == 0, F.lit("acks=all\n")).otherwise(F.lit("")),
        F.when(key % 4 == 0, F.lit("enableTransaction=true\n")).otherwise(F.lit("")),
        F.when(key % 8 == 0, F.concat(F.lit("eventsPerTransaction="), (key % 50 + 1).cast("string")))
        .when(key % 8 == 4, F.lit("eventPerTransaction=9"))
        .otherwise(F.lit("")),
    )
    return config.parse_properties(common), config.parse_properties(specific)


@query(
    "p20_merge_properties",
    """
    SELECT o_orderkey,
      'acks=' || CASE WHEN o_orderkey % 3 = 0 THEN 'all' ELSE '2' END
      || ';batch.size=' || CAST(o_custkey AS VARCHAR)
      || CASE WHEN o_orderkey % 4 = 0 THEN ';enableTransaction=true' ELSE '' END
      || CASE WHEN o_orderkey % 8 = 0
              THEN ';eventsPerTransaction=' || CAST(o_orderkey % 50 + 1 AS VARCHAR)
              WHEN o_orderkey % 8 = 4 THEN ';eventPerTransaction=9' ELSE '' END
      || ';linger.ms=' || CAST(o_orderkey % 7 AS VARCHAR) AS properties
    FROM orders""",
)
def p20_merge_properties(spark, sf_dir):
    merged = config.merge_properties(*_properties_text())
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", config.properties_text(merged).alias("properties")
    )


@query(
    "p21_enum_default",
    """
    SELECT p_partkey AS workload_id, CASE p_partkey % 5 WHEN 0 THEN 'KEY_ROUND_ROBIN'
      WHEN 2 THEN 'RANDOM_NANO' ELSE 'NO_KEY' END AS key_mode
    FROM part""",
)
def p21_enum_default(spark, sf_dir):
    mode = config.enum_default(F.col("key_distributor"))
    return recipes.workloads(spark, sf_dir).select("workload_id", mode.alias("key_mode"))


@query(
    "p22_transaction_mode",
    """
    SELECT o_orderkey, o_orderkey % 4 = 0 AS enabled,
      CAST(CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 50 + 1
                WHEN o_orderkey % 2 = 0 THEN 100 ELSE 1 END AS INTEGER) AS batch_size
    FROM orders""",
)
def p22_transaction_mode(spark, sf_dir):
    props = config.merge_properties(*_properties_text())
    system = F.when(F.col("o_orderkey") % 2 == 0, F.lit("kafka")).otherwise(F.lit("stamped-stream"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        config.transaction_enabled(props).alias("enabled"),
        config.events_per_transaction(system, props).alias("batch_size"),
    )


@query(
    "p23_workload_defaults",
    """
    SELECT p_partkey AS workload_id, CASE WHEN p_partkey % 3 = 1 THEN 100 ELSE 0 END::BIGINT AS backlog_gb,
      [15, 240, 5, 0][CAST(p_partkey % 4 AS INTEGER) + 1]::BIGINT AS test_duration_minutes
    FROM part""",
)
def p23_workload_defaults(spark, sf_dir):
    return recipes.workloads(spark, sf_dir).select(
        "workload_id",
        *[long(config.or_zero(F.col(c))).alias(c) for c in ("backlog_gb", "test_duration_minutes")],
    )
