"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are counted."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# --- SQL shared by the oracles -------------------------------------------------

SENT = """
sent AS (
  SELECT event_id % 3 AS run_id, event_id AS seq, event_type AS topic,
         event_id % 4 AS "partition", (event_id // 3) % 3 AS worker,
         event_id % 8 AS producer_id, event_id // 8 AS producer_seq,
         CAST(user_id AS VARCHAR) AS key, props AS payload,
         CAST(length(props) AS BIGINT) AS bytes, event_id * 360 AS send_ms,
         CASE WHEN event_id % 97 = 0 THEN 'failed' ELSE 'ok' END AS status,
         CAST(round(value * 1000) AS BIGINT) AS latency_us,
         event_id * 360 + CAST(round(value) AS BIGINT) AS ack_ms,
         CAST(round(value) AS BIGINT) AS value_ms
  FROM events)"""

RECV = SENT + """,
subs AS (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS subscription),
recv AS (
  SELECT run_id, worker, topic, "partition", subscription, seq, bytes, send_ms AS publish_ms,
         send_ms + value_ms * (subscription + 1)
           - CASE WHEN seq % 50 = 0 THEN 1000 ELSE 0 END AS receive_ms
  FROM sent CROSS JOIN subs
  WHERE status = 'ok' AND (seq + subscription) % 41 <> 0)"""

HELD = RECV + """,
held AS (
  SELECT run_id, subscription, seq, bytes, publish_ms,
         CASE WHEN (publish_ms // 300000) % 2 = 1
              THEN greatest(receive_ms, (publish_ms // 300000 + 1) * 300000)
              ELSE receive_ms END AS receive_ms
  FROM recv)"""


def bucket_sql(v: str) -> str:
    bits = f"(length(bin({v})) - 18)"
    return (
        f"CASE WHEN {v} < 262144 THEN {v} "
        f"ELSE ((({v} >> {bits}) + 1) << {bits}) - 1 END"
    )


PUBLISHED_ONLY = f"""
published AS (
  SELECT run_id, send_ms // 10000 AS period, worker, bytes, latency_us,
         {bucket_sql("latency_us")} AS bucket
  FROM sent WHERE status = 'ok' AND send_ms >= 60000)"""

PUBLISHED = f"{SENT},{PUBLISHED_ONLY}"

DELIVERED_ONLY = f"""
lat AS (
  SELECT *, least(greatest((receive_ms - publish_ms) * 1000, 0), 43200000000) AS us FROM recv
  WHERE receive_ms >= 60000),
delivered AS (
  SELECT run_id, receive_ms // 10000 AS period, bytes,
         CASE WHEN us > 0 THEN us END AS latency_us,
         CASE WHEN us > 0 THEN {bucket_sql("us")} END AS bucket
  FROM lat)"""

DELIVERED = f"{RECV},{DELIVERED_ONLY}"

QUANTILE_NAMES = {
    "50pct": 5000, "75pct": 7500, "95pct": 9500, "99pct": 9900, "999pct": 9990, "9999pct": 9999,
}


def ranked_sql(source: str, keys: str) -> str:
    """Rank every recorded latency by bucket within ``keys``; NULL buckets rank last."""
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bucket NULLS LAST) AS rn, "
        f"count(bucket) OVER (PARTITION BY {keys}) AS total FROM {source}"
    )


def summary_sql(prefix: str = "latency") -> str:
    """Select list of mean, quantiles and maximum over ranked rows."""
    picks = [f"round(coalesce(avg(latency_us) / 1000, 0), 6) AS {prefix}_avg"]
    picks += [
        f"round(coalesce(min(bucket) FILTER (WHERE rn <= total AND rn * 10000 >= {q} * total)"
        f" / 1000, 0), 6) AS {prefix}_{name}"
        for name, q in QUANTILE_NAMES.items()
    ]
    picks.append(f"round(coalesce(max(bucket) / 1000, 0), 6) AS {prefix}_max")
    return ", ".join(picks)


LATENCY_COLUMNS = ("latency_avg", *[f"latency_{n}" for n in QUANTILE_NAMES], "latency_max")

SYSTEM_LIST = (
    "['kafka','pulsar','rocketmq','artemis','nsq',"
    "'distributedlog','rabbitmq','nats-streaming','nats','stamped-stream']"
)


def system_sql(ident: str) -> str:
    return f"{SYSTEM_LIST}[CAST({ident} % 10 AS INTEGER) + 1]"


def token_sql(seed: str, ident: str, n_bytes: int) -> str:
    digest = f"substr(sha256('{seed}' || {ident}), 1, {2 * n_bytes})"
    return f"rtrim(translate(base64(unhex({digest})), '+/', '-_'), '=')"
