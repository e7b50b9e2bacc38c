"""Registered result-document, chart, configuration and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import filters
from tidewire.plans import charts, recipes, reports
from tidewire.plans.catalog.logs import COUNTERS_SQL, CURVE_SQL
from tidewire.plans.catalog.registry import (
    DELIVERED_ONLY, PUBLISHED_ONLY, RECV, SENT, query, ranked_sql, rounded, token_sql,
)
from tidewire.plans.recipes import long, table
from tidewire.schemas import EVENTS
from tidewire.session import shared_folder
from tidewire.sources import configs, message_log, results

# (run_id, workload, driver)
RUNS = [
    (0, "steady-small", "kafka"),
    (1, "steady-medium", "kafka"),
    (2, "wide/fan-out", "pulsar"),
]

RUNS_SQL = """
runs(run_id, workload, driver) AS (
  VALUES (0, 'steady-small', 'kafka'), (1, 'steady-medium', 'kafka'),
         (2, 'wide-fan-out', 'pulsar'))"""


def _runs(spark) -> DataFrame:
    return spark.createDataFrame(RUNS, "run_id bigint, workload string, driver string")


def _series(spark, sf_dir, metric: str) -> DataFrame:
    return reports.series_documents(
        recipes.sends(spark, sf_dir), recipes.receives(spark, sf_dir), _runs(spark), metric
    )


def _documents(spark, sf_dir) -> DataFrame:
    return reports.result_documents(
        recipes.sends(spark, sf_dir), recipes.receives(spark, sf_dir), _runs(spark),
        subscriptions=recipes.SUBSCRIPTIONS, message_size=1024,
    )


def _chart_sql(value: str, places: int = 6) -> str:
    """Points of one series over the reported periods, those after warm-up."""
    return f"""
    placed AS (
      SELECT run_id, 10 * (row_number() OVER (PARTITION BY run_id ORDER BY period) - 1) AS x, y
      FROM (SELECT c.run_id, c.period, {value} AS y FROM reported c
            LEFT JOIN stats s USING (run_id, period)))
    SELECT workload, driver, x, round(y, {places}) AS y FROM placed JOIN runs USING (run_id)"""


_PUBLISH_STATS = f"""
{COUNTERS_SQL}, {PUBLISHED_ONLY},
stats AS (
  SELECT run_id, period, min(bucket) FILTER (WHERE rn * 10000 >= 9900 * total) / 1000 AS p99
  FROM ({ranked_sql("published", "run_id, period")}) GROUP BY run_id, period)"""

_E2E_STATS = f"""
{COUNTERS_SQL}, {DELIVERED_ONLY},
stats AS (
  SELECT run_id, period, avg(latency_us) / 1000 AS mean FROM delivered GROUP BY run_id, period)"""


@query(
    "r1_series_publish_p99",
    f"WITH {_PUBLISH_STATS}, {RUNS_SQL}, {_chart_sql('coalesce(s.p99, 0)')}",
)
def r1_series_publish_p99(spark, sf_dir):
    return rounded(charts.series_publish_p99(_series(spark, sf_dir, "publishLatency99pct")), "y")


@query(
    "r2_series_publish_rate",
    f"WITH {_PUBLISH_STATS}, {RUNS_SQL}, {_chart_sql('c.messages_sent / 10.0::DOUBLE')}",
)
def r2_series_publish_rate(spark, sf_dir):
    return rounded(charts.series_publish_rate(_series(spark, sf_dir, "publishRate")), "y")


@query(
    "r3_series_consume_rate",
    f"WITH {_PUBLISH_STATS}, {RUNS_SQL}, {_chart_sql('c.messages_received / 10.0::DOUBLE')}",
)
def r3_series_consume_rate(spark, sf_dir):
    return rounded(charts.series_consume_rate(_series(spark, sf_dir, "consumeRate")), "y")


@query(
    "r4_series_e2e_avg",
    f"WITH {_E2E_STATS}, {RUNS_SQL}, {_chart_sql('coalesce(s.mean, 0)')}",
)
def r4_series_e2e_avg(spark, sf_dir):
    return rounded(charts.series_e2e_avg(_series(spark, sf_dir, "endToEndLatencyAvg")), "y")


@query(
    "r5_quantile_series",
    f"""
    WITH {CURVE_SQL}, {RUNS_SQL}
    SELECT workload, driver, round(percentile, 6) AS percentile,
           round(log10(100.0::DOUBLE / (100.0::DOUBLE - percentile)), 6) AS x, round(value_ms, 6) AS y
    FROM curve JOIN runs USING (run_id) WHERE percentile <= 99.999""",
)
def r5_quantile_series(spark, sf_dir):
    documents = reports.curve_documents(recipes.sends(spark, sf_dir), _runs(spark))
    return rounded(charts.quantile_series(documents), "percentile", "x", "y")


@query(
    "a19_group_by_workload",
    f"""
    WITH {SENT}, {RUNS_SQL}, present AS (SELECT DISTINCT run_id FROM sent)
    SELECT workload, count(*) AS documents, count(DISTINCT driver) AS drivers
    FROM present JOIN runs USING (run_id) GROUP BY workload""",
)
def a19_group_by_workload(spark, sf_dir):
    present = recipes.sends(spark, sf_dir).select("run_id").distinct().join(_runs(spark), "run_id")
    return charts.group_by_workload(present.withColumn("part", long(0)))


@query(
    "s2_write_results",
    f"""
    WITH {COUNTERS_SQL}, {RUNS_SQL}
    SELECT CASE workload WHEN 'wide-fan-out' THEN 'wide/fan-out' ELSE workload END AS workload, driver, count(*) AS periods,
           round(max(messages_sent) / 10.0::DOUBLE, 6) AS best_rate
    FROM reported JOIN runs USING (run_id) GROUP BY ALL""",
)
def s2_write_results(spark, sf_dir):
    """Documents written as JSON and read back, with the length of their arrays."""
    folder = shared_folder(spark, "results")
    results.write_results(_documents(spark, sf_dir), folder)
    documents = results.read_results(spark, folder, one_per_file=False)
    return rounded(
        documents.groupBy("workload", "driver").agg(
            F.sum(F.size("publishRate")).cast("bigint").alias("periods"),
            F.max(F.array_max("publishRate")).alias("best_rate"),
        ),
        "best_rate",
    )


@query(
    "s1_read_results",
    f"""
    WITH {COUNTERS_SQL}, {RUNS_SQL}, s AS (
      SELECT run_id, arg_max(3 * total_sent - total_received, period) AS last_backlog FROM totals GROUP BY 1)
    SELECT driver, CAST(count(*) AS BIGINT) AS documents, CAST(sum(last_backlog) AS BIGINT) AS backlog
    FROM s JOIN runs USING (run_id) GROUP BY driver""",
)
def s1_read_results(spark, sf_dir):
    folder = shared_folder(spark, "results")
    results.write_results(_documents(spark, sf_dir), folder)
    documents = results.read_results(spark, folder, one_per_file=False)
    last = F.element_at("backlog", -1)
    latest = documents.groupBy("driver", "workload").agg(F.max_by(last, "part").alias("backlog"))
    return latest.groupBy("driver").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("backlog").alias("backlog")
    )


# --- configuration and payload files ---------------------------------------------------


def _workload_files(spark, sf_dir) -> DataFrame:
    """Workload configurations of ``part`` as the text of one file each."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = recipes.workloads(spark, sf_dir)
    text = F.concat_ws(
        "\n",
        F.lit("# generated\n"),
        F.concat(F.lit('name: "'), F.col("name"), F.lit('"\n')),
        F.concat(F.lit("topics: "), number("topics")),
        F.concat(F.lit("partitionsPerTopic: "), number("partitions_per_topic")),
        F.concat(F.lit("keyDistributor: "), F.col("key_distributor")),
        F.concat(F.lit("messageSize: "), number("message_size")),
        F.concat(F.lit('payloadFile: "payload/p-'), number("message_size"), F.lit('.data"')),
        F.concat(F.lit("producerRate: "), number("producer_rate")),
        F.concat(F.lit("consumerBacklogSizeGB: "), number("backlog_gb")),
        F.lit("someFutureField: 12"),
    )
    name = F.format_string("w-%d.v2.yaml", F.col("workload_id"))
    return rows.select(name.alias("file"), text.alias("text"))


@query(
    "s3_read_workloads",
    """
    SELECT printf('w-%d.v2', p_partkey) AS workload, printf('%s-%06d', p_name, p_partkey) AS name,
      p_size % 5 AS topics, [1, 1, 16, 100][p_size % 4 + 1] AS partitions_per_topic,
      CASE p_partkey % 5 WHEN 0 THEN 'KEY_ROUND_ROBIN' WHEN 2 THEN 'RANDOM_NANO' ELSE 'NO_KEY' END
        AS key_distributor,
      [100, 1024, 2727][CAST(p_partkey % 3 AS INTEGER) + 1] AS message_size,
      'payload/p-' || [100, 1024, 2727][CAST(p_partkey % 3 AS INTEGER) + 1] || '.data' AS payload_file,
      [50000, 0, 10000, -1, 2147483647][CAST(p_partkey % 5 AS INTEGER) + 1] AS producer_rate,
      CASE WHEN p_partkey % 3 = 1 THEN 100 ELSE 0 END::BIGINT AS backlog_gb,
      0::INTEGER AS test_duration_minutes
    FROM part""",
)
def s3_read_workloads(spark, sf_dir):
    """Workload files in the shared folder, as a user has them."""
    folder = shared_folder(spark, "workloads")
    configs.write_texts(_workload_files(spark, sf_dir), folder)
    parsed = configs.read_workloads(spark, folder)
    return parsed.select(
        "workload", "name", "topics", "partitions_per_topic", "key_distributor", "message_size",
        "payload_file", "producer_rate", "backlog_gb", "test_duration_minutes",
    )


@query(
    "s4_read_drivers",
    """
    SELECT s_suppkey, s_name AS name, 'bench.' || s_nationkey AS driver_class,
           CAST(s_nationkey AS VARCHAR) AS io_threads, 'acks=all' || chr(10) || 'linger.ms='
             || s_nationkey || chr(10) AS producer_config
    FROM supplier""",
)
def s4_read_drivers(spark, sf_dir):
    nation = F.col("s_nationkey").cast("string")
    text = F.concat(
        F.lit("name: "), F.col("s_name"), F.lit("\ndriverClass: bench."), nation,
        F.lit("\n\nclient:\n  # threads\n  ioThreads: "), nation,
        F.lit("\n  persistence:\n    ensembleSize: 3\nproducerConfig: |\n  acks=all\n  linger.ms="),
        nation, F.lit("\n\nreplicationFactor: 3\n"),
    )
    files = table(spark, sf_dir, "supplier").select(
        F.format_string("%d.yaml", F.col("s_suppkey")).alias("file"), text.alias("text")
    )
    folder = shared_folder(spark, "drivers")
    configs.write_texts(files, folder)
    drivers = configs.read_drivers(spark, folder)
    extra = F.col("extra")
    return drivers.select(
        F.regexp_extract("path", r"(\d+)\.yaml$", 1).cast("bigint").alias("s_suppkey"),
        "name",
        "driver_class",
        extra["client.ioThreads"].alias("io_threads"),
        extra["producerConfig"].alias("producer_config"),
    )


@query(
    "s5_read_payloads",
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'missing payload'
      WHEN s_suppkey % 5 = 0 THEN 'payload length mismatch' END AS reason,
      CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 50 + 1) * length(s_name) + 1 END AS payload_length
    FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0""",
)
def s5_read_payloads(spark, sf_dir):
    """Payload files of the shared folder against their workloads: some are absent, some of another length."""
    rows = table(spark, sf_dir, "supplier")
    stem = F.format_string("payload-%d.data", F.col("s_suppkey"))
    content = F.repeat("s_name", (F.col("s_suppkey") % 50 + 1).cast("int"))
    folder = shared_folder(spark, "payloads")
    present = rows.where(F.col("s_suppkey") % 7 != 0)
    configs.write_texts(present.select(stem.alias("file"), content.alias("text")), folder)
    expected = F.octet_length(content) + F.lit(1) + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)
    none = F.lit(None)
    workloads = rows.select(
        "s_suppkey", F.col("s_suppkey").cast("string").alias("name"), F.concat(F.lit("payload/"), stem).alias("payload_file"),
        long(expected).alias("message_size"), long(0).alias("backlog_gb"), long(1).alias("producer_rate"),
        long(none).alias("n_workers"), none.cast("string").alias("worker_list"), none.cast("string").alias("workers_file"),
    )
    checked = configs.check_payloads(workloads, configs.read_payloads(spark, folder, pattern="part-*"))
    lengths = checked.select(F.col("name").alias("workload"), "s_suppkey", "payload_length")
    problems = filters.invalid_configs(checked)
    return problems.join(lengths, "workload").select("s_suppkey", "reason", "payload_length")


# --- message logs -----------------------------------------------------------------------


@query(
    "s6_read_message_log",
    f"""
    WITH {RECV}
    SELECT topic, "partition", subscription, count(*) AS messages, min(seq) AS first_seq,
           max(seq) AS last_seq, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM recv GROUP BY topic, "partition", subscription""",
)
def s6_read_message_log(spark, sf_dir):
    events = message_log.read_message_log(spark, f"{sf_dir}/events.parquet", EVENTS)
    received = recipes.receive_columns(recipes.send_columns(events))
    return received.groupBy("topic", "partition", "subscription").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.sum("bytes").alias("bytes"),
    )


@query(
    "s8_synthesize_messages",
    f"""
    WITH producers AS (SELECT c_custkey AS producer_id, c_nationkey % 20 AS n FROM customer),
    m AS (SELECT producer_id, CAST(unnest(range(n)) AS BIGINT) AS seq FROM producers)
    SELECT producer_id, seq, {token_sql("keys", "((seq + 1) % 10000)", 7)} AS key,
           'payload-' || producer_id AS payload, seq * 250 AS send_ms
    FROM m""",
)
def s8_synthesize_messages(spark, sf_dir):
    """Up to 19 messages per customer, laid out in blocks of 8."""
    producers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("producer_id"), "c_nationkey"
    )
    payload = F.concat(F.lit("payload-"), F.col("producer_id").cast("string"))
    made = message_log.synthesize_messages(
        producers, count=F.col("c_nationkey") % 20, key_mode="KEY_ROUND_ROBIN",
        payload=payload, spacing_ms=250, block=8,
    )
    return made.drop("c_nationkey")
