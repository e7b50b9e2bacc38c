"""Registered metric-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import label, label_match, series_id, series_label
from tidewire.operators import joins, lookback
from tidewire.plans import dashboards, recipes
from tidewire.plans.catalog.registry import SENT, query, rounded
from tidewire.session import shared_folder
from tidewire.sources import metrics

GROUPS = ("client", "broker", "bookie")
PLACES = 6

# --- oracles: every look-back is a range join of the grid with the samples ----------

COUNTERS = (
    SENT
    + """,
slots AS (
  SELECT worker, send_ms // 15000 AS slot, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS n_bytes,
         max(latency_us) AS worst_us FROM sent GROUP BY ALL),
epochs AS (SELECT *, CASE WHEN worker = 2 THEN slot // 120 ELSE 0 END AS epoch FROM slots),
counters AS (
  SELECT worker, 'w' || worker AS instance, (slot + 1) * 15000 + worker * 1000 AS ts_ms, n, n_bytes,
         worst_us, CAST(sum(n) OVER w AS DOUBLE) AS total, CAST(sum(n_bytes) OVER w AS DOUBLE) AS total_bytes
  FROM epochs WINDOW w AS (PARTITION BY worker, epoch ORDER BY slot))"""
)


def seen_sql(value: str, range_ms: int) -> str:
    """CTEs up to ``seen``: all samples each grid time looks back on, latest first."""
    return f"""{COUNTERS},
samples AS (SELECT instance, ts_ms, CAST({value} AS DOUBLE) AS v FROM counters),
grid AS (SELECT unnest(range(0, (SELECT max(ts_ms) FROM samples) + {range_ms} + 1, 15000)) AS t_ms),
seen AS (
  SELECT instance, t_ms, ts_ms, v,
         row_number() OVER (PARTITION BY instance, t_ms ORDER BY ts_ms DESC) AS rn
  FROM grid JOIN samples ON ts_ms BETWEEN t_ms - {range_ms} AND t_ms)"""


def irate_sql(value: str, range_ms: int) -> str:
    return f"""{seen_sql(value, range_ms)},
points AS (
  SELECT a.instance, a.t_ms,
         (CASE WHEN a.v < b.v THEN a.v ELSE a.v - b.v END) / ((a.ts_ms - b.ts_ms) / 1000.0::DOUBLE) AS value
  FROM seen a JOIN seen b ON a.instance = b.instance AND a.t_ms = b.t_ms AND a.rn = 1 AND b.rn = 2)"""


def instant_sql(value: str) -> str:
    return f"""{seen_sql(value, 300000)},
points AS (SELECT instance, t_ms, v AS value FROM seen WHERE rn = 1)"""


def increase_sql(value: str, range_ms: int) -> str:
    """Deltas between neighbours inside each look-back, then both edges one by one."""
    return f"""{seen_sql(value, range_ms)},
steps AS (
  SELECT *, lag(v) OVER (PARTITION BY instance, t_ms ORDER BY ts_ms) AS before FROM seen),
grown AS (
  SELECT instance, t_ms, count(*) AS k, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
         arg_min(v, ts_ms) AS first_v,
         sum(CASE WHEN before IS NULL THEN 0 WHEN v < before THEN v ELSE v - before END) AS growth
  FROM steps GROUP BY instance, t_ms HAVING count(*) > 1),
spans AS (
  SELECT *, (last_ms - first_ms) / 1000.0::DOUBLE AS sampled,
         (last_ms - first_ms) / 1000.0::DOUBLE / (k - 1) AS distance,
         (first_ms - (t_ms - {range_ms})) / 1000.0::DOUBLE AS to_start,
         (t_ms - last_ms) / 1000.0::DOUBLE AS to_end FROM grown),
edges AS (
  SELECT *, CASE WHEN growth > 0 AND first_v >= 0 AND sampled * (first_v / growth) < to_start
                 THEN sampled * (first_v / growth) ELSE to_start END AS near_start FROM spans),
points AS (
  SELECT instance, t_ms, growth * (sampled
      + CASE WHEN near_start < distance * 1.1::DOUBLE THEN near_start ELSE distance / 2 END
      + CASE WHEN to_end < distance * 1.1::DOUBLE THEN to_end ELSE distance / 2 END) / sampled AS value
  FROM edges)"""


_GROUP_ROWS = """(SELECT unnest(['client', 'broker', 'bookie']) AS "group")"""


def _points(points: DataFrame, *columns: str) -> DataFrame:
    return rounded(points.select(*columns, "t_ms", "value"), "value", places=PLACES)


# --- sources, labels -------------------------------------------------------------------


@query(
    "s9_read_metric_samples",
    f"""
    WITH {COUNTERS}
    SELECT 'benchmark_producer_messages_sent{{group="client",instance="' || instance || '"}}' AS series,
           1704067200000 + ts_ms AS ts_ms, total AS value
    FROM counters""",
)
def s9_read_metric_samples(spark, sf_dir):
    """Samples as files of exposition text (with its comments) and as a table, read back through the readers."""
    counters = recipes.sampled_counters(spark, sf_dir)
    line = F.format_string(
        'benchmark_producer_messages_sent{instance="w%d",group="client"} %s %d',
        F.col("worker"), F.col("total").cast("double").cast("string"),
        F.col("ts_ms") + F.lit(recipes.EPOCH_MS),
    )
    comment = F.lit("# TYPE benchmark_producer_messages_sent counter")
    lines = counters.select(F.explode(F.array(comment, line)).alias("line"))
    folder = shared_folder(spark, "samples")
    lines.write.text(f"{folder}/text")
    parsed = metrics.read_exposition(spark, f"{folder}/text")
    rows = parsed.select("name", "labels", F.col("ts_ms"), "value")
    rows.write.parquet(f"{folder}/table")
    samples = metrics.read_metric_samples(spark, f"{folder}/table")
    return samples.select(series_id(F.col("name"), F.col("labels")).alias("series"), "ts_ms", "value")


@query(
    "f8_label_match",
    f"""
    WITH {COUNTERS}, devices AS (SELECT unnest(['eth0', 'lo', 'veth1', '']) AS device)
    SELECT instance, device, count(*) AS samples,
           count(*) FILTER (WHERE NOT regexp_full_match(device, 'veth.*|lo')) AS real_device,
           count(*) FILTER (WHERE regexp_full_match(instance, 'w(0|2)')) AS chosen,
           count(*) FILTER (WHERE device = '') AS no_device
    FROM counters, devices GROUP BY instance, device""",
)
def f8_label_match(spark, sf_dir):
    names = ["node_network_transmit_bytes_total", "process_cpu_seconds_total"]
    labels = F.col("labels")
    samples = recipes.metric_samples(spark, sf_dir, *names).where(label(labels, "group") == "client")
    return samples.groupBy(
        label(labels, "instance").alias("instance"), label(labels, "device").alias("device")
    ).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(label_match(labels, "device", "!~", "veth.*|lo")).alias("real_device"),
        F.count_if(label_match(labels, "instance", "=~", "w(0|2)")).alias("chosen"),
        F.count_if(label_match(labels, "device", "=", "")).alias("no_device"),
    )


# (target, job, group): w0 is scraped as a client, w1 as broker and bookie.
TARGETS = [("w0", "benchmark", "client"), ("w1", "stack", "broker"), ("w1", "stack", "bookie")]


@query(
    "j6_attach_target_labels",
    f"""
    WITH {COUNTERS}, targets(instance, job, grp) AS (
      VALUES ('w0', 'benchmark', 'client'), ('w1', 'stack', 'broker'), ('w1', 'stack', 'bookie'))
    SELECT 'total{{group="' || grp || '",instance="' || instance || '",job="' || job || '"}}' AS series,
           ts_ms, total AS value
    FROM counters JOIN targets USING (instance)""",
)
def j6_attach_target_labels(spark, sf_dir):
    instance = F.concat(F.lit("w"), F.col("worker").cast("string"))
    samples = recipes.sampled_counters(spark, sf_dir).select(
        instance.alias("target"),
        F.create_map(F.lit("instance"), instance).alias("labels"),
        "ts_ms",
        F.col("total").cast("double").alias("value"),
    )
    targets = spark.createDataFrame(TARGETS, "target string, job string, `group` string")
    labelled = joins.attach_target_labels(samples, targets)
    return labelled.select(
        series_id(F.lit("total"), F.col("labels")).alias("series"), "ts_ms", "value"
    )


# --- look-back operators ------------------------------------------------------------------


def _series(spark, sf_dir, name: str) -> DataFrame:
    samples = recipes.metric_samples(spark, sf_dir, name)
    return lookback.select_series(samples, name, ("group", "=", "client"))


def _with_instance(points: DataFrame) -> DataFrame:
    return _points(points.withColumn("instance", label(F.col("labels"), "instance")), "instance")


_POINTS = f"SELECT instance, t_ms, round(value, {PLACES}) AS value FROM points"


@query("m1_irate", f"WITH {irate_sql('total', 90000)} {_POINTS}")
def m1_irate(spark, sf_dir):
    """Blocks of ten minutes, so that look-backs cross block edges."""
    chosen = _series(spark, sf_dir, "benchmark_producer_messages_sent")
    return _with_instance(lookback.irate(chosen, 90_000, block_ms=600_000))


@query("m2_increase", f"WITH {increase_sql('total', 100000)} {_POINTS}")
def m2_increase(spark, sf_dir):
    chosen = _series(spark, sf_dir, "benchmark_producer_messages_sent")
    return _with_instance(lookback.increase(chosen, 100_000, block_ms=600_000))


@query("m3_instant", f"WITH {instant_sql('worst_us')} {_POINTS}")
def m3_instant(spark, sf_dir):
    chosen = _series(spark, sf_dir, "benchmark_consumer_e2e_latency").where(
        label_match(F.col("labels"), "quantile", "=", "0.5")
    )
    return _with_instance(lookback.instant(chosen, block_ms=600_000))


# --- dashboard panels ------------------------------------------------------------------------

_LEGEND = f"SELECT instance AS legend, t_ms, round(value, {PLACES}) AS value FROM points"


def _client_panel(name: str, column: str, panel, metric: str) -> None:
    @query(name, f"WITH {irate_sql(column, 30000)} {_LEGEND}")
    def run(spark, sf_dir):
        return _points(panel(recipes.metric_samples(spark, sf_dir, metric)), "legend")


_client_panel(
    "m4_producer_msg_rate", "total", dashboards.producer_msg_rate,
    "benchmark_producer_messages_sent",
)
_client_panel(
    "m5_consumer_msg_rate", "total", dashboards.consumer_msg_rate,
    "benchmark_consumer_messages_recv",
)
_client_panel(
    "m6_producer_byte_rate", "total_bytes", dashboards.producer_byte_rate,
    "benchmark_producer_bytes_sent",
)
_client_panel(
    "m7_consumer_byte_rate", "total_bytes", dashboards.consumer_byte_rate,
    "benchmark_consumer_bytes_recv",
)


def _latency_panel(name: str, panel, metric: str) -> None:
    @query(
        name,
        f"""WITH {instant_sql("worst_us")}
        SELECT instance || ' - ' || unnest(['50%', '99%']) AS legend, t_ms, value FROM points""",
    )
    def run(spark, sf_dir):
        samples = recipes.metric_samples(spark, sf_dir, metric)
        both = panel(samples, "0.5").unionByName(panel(samples, "0.99"))
        return _points(both, "legend")


_latency_panel(
    "m8_produce_latency_q", dashboards.produce_latency_q, "benchmark_producer_produce_latency"
)
_latency_panel("m9_e2e_latency_q", dashboards.e2e_latency_q, "benchmark_consumer_e2e_latency")


@query(
    "m10_cpu_percent",
    f"""WITH {irate_sql("total", 30000)}
    SELECT "group", instance AS legend, t_ms, round(value * 100, {PLACES}) AS value
    FROM points, {_GROUP_ROWS}""",
)
def m10_cpu_percent(spark, sf_dir):
    samples = recipes.metric_samples(spark, sf_dir, "process_cpu_seconds_total")
    return _points(dashboards.cpu_percent(samples, GROUPS), "group", "legend")


@query(
    "m11_heap_sums",
    f"""WITH {instant_sql("n_bytes")}, summed AS (SELECT t_ms, sum(value) AS v FROM points GROUP BY t_ms)
    SELECT "group", area, t_ms, round(v * copies, {PLACES}) AS value
    FROM summed, {_GROUP_ROWS},
         (VALUES ('committed', 2), ('used', 1), ('max', 1)) areas(area, copies)""",
)
def m11_heap_sums(spark, sf_dir):
    """Committed memory is sampled for two areas of the heap."""
    names = [f"jvm_memory_bytes_{area}" for area in ("committed", "used", "max")]
    samples = recipes.metric_samples(spark, sf_dir, *names)
    return _points(dashboards.heap_sums(samples, GROUPS), "group", "area")


@query(
    "m12_direct_memory",
    f"""WITH {instant_sql("n_bytes")}
    SELECT "group", area, instance, t_ms, value
    FROM points, {_GROUP_ROWS}, (SELECT unnest(['used', 'max']) AS area)""",
)
def m12_direct_memory(spark, sf_dir):
    names = [f"jvm_memory_direct_bytes_{area}" for area in ("used", "max")]
    points = dashboards.direct_memory(recipes.metric_samples(spark, sf_dir, *names), GROUPS)
    named = points.withColumn("instance", label(F.col("labels"), "instance"))
    return _points(named, "group", "area", "instance")


@query(
    "m13_gc_pause",
    f"""WITH {increase_sql("total", 30000)}
    SELECT "group", t_ms, round(2 * sum(value), 4) AS value
    FROM points, {_GROUP_ROWS} GROUP BY "group", t_ms""",
)
def m13_gc_pause(spark, sf_dir):
    """Two collectors per instance, summed."""
    samples = recipes.metric_samples(spark, sf_dir, "jvm_gc_collection_seconds_sum")
    paused = dashboards.gc_pause(samples, GROUPS)
    return rounded(paused.select("group", "t_ms", "value"), "value", places=4)


def _disk_panel(name: str, direction: str) -> None:
    @query(
        name,
        f"""WITH {irate_sql("total_bytes", 300000)}
        SELECT 'client ' || instance AS legend, t_ms, round(2 * value, {PLACES}) AS value FROM points""",
    )
    def run(spark, sf_dir):
        samples = recipes.metric_samples(spark, sf_dir, f"node_disk_{direction}_bytes_total")
        return _points(dashboards.disk_bytes(samples, direction), "legend")


_disk_panel("m14_disk_write", "written")
_disk_panel("m14_disk_read", "read")


def _network_panel(name: str, direction: str) -> None:
    @query(
        name,
        f"""WITH {irate_sql("total_bytes", 300000)}
        SELECT 'client ' || instance || ' eth0' AS legend, t_ms, round(value, {PLACES}) AS value
        FROM points""",
    )
    def run(spark, sf_dir):
        samples = recipes.metric_samples(spark, sf_dir, f"node_network_{direction}_bytes_total")
        return _points(dashboards.network_bytes(samples, direction), "legend")


_network_panel("m15_net_tx", "transmit")
_network_panel("m15_net_rx", "receive")


@query(
    "m16_cpu_busy",
    f"""WITH {irate_sql("total", 300000)}
    SELECT 'client ' || instance AS legend, t_ms, round(1 - value, {PLACES}) AS value FROM points""",
)
def m16_cpu_busy(spark, sf_dir):
    samples = recipes.metric_samples(spark, sf_dir, "node_cpu_seconds_total")
    return _points(dashboards.cpu_busy(samples), "legend")


@query(
    "m17_series_label",
    f"""
    WITH {COUNTERS}
    SELECT instance || ' - 50% /' AS legend, ts_ms FROM counters""",
)
def m17_series_label(spark, sf_dir):
    """A label the series lacks leaves its place empty."""
    chosen = _series(spark, sf_dir, "process_cpu_seconds_total")
    template = "{{ instance }} - 50% /{{device}}"
    return chosen.select(series_label(template, F.col("labels")).alias("legend"), "ts_ms")
